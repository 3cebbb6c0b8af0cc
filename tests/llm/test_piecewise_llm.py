from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL

from kpisleuth.llm import piecewise
from kpisleuth.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def plain(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return np.asarray(ids, "<u4").tobytes(), library.decode(ids)


def test_query_against_library(spark, library):
    docs = {r["doc_id"]: plain(library, r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_piece_codes"].run(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids, text = docs[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


ODD = [(1, None), (2, ""), (3, "   "), (4, " \n\t \r\n"), (5, "▁▁a ▁b▁"), (5, "again"), (None, "no id"), (6, "a" * 50_000),
       (7, "日本語のテキスト。" * 3000), (7, "日本語のテキスト。" * 3000), (8, "x\x00y 🙂é́ſİ  <s></s><unk><0x0A>"), (9, "don't... e.g.,(foo)²."),
       (10, "\U0010ffff�")]


def test_odd_texts(spark, library):
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in ODD], "doc_id long, text string, before string, ids binary").repartition(3)
    rows = piecewise.decoded(piecewise.encoded(docs, PATH), PATH).collect()
    want = [(i, *plain(library, t)) for i, t in ODD]
    assert sorted(((r[0], bytes(r[1]), r[2]) for r in rows), key=str) == sorted(want, key=str)


def test_empty_table_and_null_ids(spark):
    assert piecewise.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    codes = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert piecewise.decoded(codes, PATH).collect()[0]["text"] is None


def test_random_texts_and_small_memories(library, monkeypatch):
    monkeypatch.setattr(piecewise, "KEPT_WORDS", 50)
    monkeypatch.setattr(piecewise, "KEPT_PAIRS", 40)
    pieces, draw = piecewise.Vocabulary(PATH), random.Random(7)
    letters = [*"aabe▁  \n\tetaoin.,;é²ß\x00İſ中文字本🙂()'", "the", "ing", "  ", "1999"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        part = texts[at: at + 100]
        assert list(pieces.encode(part)) == [plain(library, t)[0] for t in part]


def test_table_holds_the_last_token_of_every_prefix(library):
    pieces = piecewise.Vocabulary(PATH)
    word = "▁unbelievablenesses"
    table = pieces.extend([piecewise.START], 0, word)
    for size in range(2, len(word) + 1):
        ids = library.encode(word[1:size])
        assert pieces.tokens[table[size]] == library.id_to_piece(ids[-1])
    longer = word + "ly"
    assert pieces.extend(table, len(word), longer) == pieces.extend([piecewise.START], 0, longer)


def test_merge_follows_its_definition(library):
    pieces, draw = piecewise.Vocabulary(PATH), random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("▁aehinorst") for _ in range(draw.randrange(1, 14)))
        symbols = list(text)
        while True:
            found = [(-pieces.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in pieces.score]
            if not found:
                break
            i = min(found)[1]
            symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]
        assert pieces.merge(text) == symbols
