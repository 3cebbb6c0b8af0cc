from __future__ import annotations

import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL

from kpisleuth.llm import packing
from kpisleuth.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start: start + capacity]
            out.append((doc, piece, start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_sequences(rows, capacity=4096):
    """Gapless, within the capacity; returns the number of sequences."""
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


def test_query_against_plain_tokenizer(spark):
    rows = QUERIES["op1_best_fit_packing"].run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == expected(docs)
    tokens = sum(r["length"] for r in rows)
    assert check_sequences(rows) <= -(-tokens // 4096) + 2


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word, Word. WORD.,. ,. isn't <|endoftext|>x"), (5, "é́ ß \x1c a b c İ ١٢"), (5, "again"),
       (None, "no id"), (6, "a" * 30_000), (7, "tok " * 9_000), (7, "tok " * 9_000), (8, "don't, 'll.. x.y,z \U0001f600.")]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ODD], "doc_id long, text string, piece string, fill int, seq int").repartition(3)
    rows = packing.packed_documents(docs, PATH).collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == expected(ODD)
    check_sequences(rows)


def test_empty_table(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    words = packing.WordTokens(PATH)
    texts = [b"one two three four", b"five, two. six,", b"", b"one one one"]
    fresh = packing.WordTokens(PATH)
    assert list(words.ids(texts)) == [next(fresh.ids([t])) for t in texts]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    steps = json.loads(Path(PATH).read_text(encoding="utf-8"))
    steps["normalizer"] = {"type": "Replace", "pattern": {"String": " "}, "content": "_"}  # joins words
    path = tmp_path / "joins.json"
    path.write_text(json.dumps(steps), encoding="utf-8")
    words = packing.WordTokens(str(path))
    texts = ["one two", "", "a  b."]
    assert not words.by_word and packing.WordTokens(PATH).by_word
    assert list(words.ids([t.encode() for t in texts])) == [
        np.asarray([*words.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]


def test_words_of_any_shape():
    words = packing.WordTokens(PATH)
    texts = ["Éa. éA, ÀÖØö,.,. x÷y ×. ß", "an%%% 'll don't. l'été,", "İ. Σας, ΣΑΣ.", "a\u0301. e\u0301,\u0301 \u00a0b\u2003c", ".", ",.", " \t"]
    assert list(words.ids([t.encode() for t in texts])) == [
        np.asarray([*words.tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("lengths", [[4096] * 5, [2049] * 7, [1] * 10_000, [3000, 1096] * 50, list(range(1, 4097, 13))])
def test_tree_packs_all_and_well(spark, lengths):
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES).repartition(8)
    rows = packing.pack(pieces).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    assert {(r["doc_id"], r["length"]) for r in rows} == set(enumerate(lengths))
    least = max(-(-sum(lengths) // 4096), sum(n > 2048 for n in lengths))
    assert check_sequences(rows) <= least + max(1, least // 15)


def test_best_fit_takes_fullest_bin():
    bins, places = packing.best_fit(np.array([60, 50, 35, 30, 10]), 100)
    assert bins.tolist() == [0, 1, 0, 1, 1] and places.tolist() == [0, 0, 60, 50, 80]
