from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from compare import check
from conftest import SMALL

from kpisleuth.llm import variants
from kpisleuth.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows):
    upper = {c: c + 32 for c in range(65, 91)}
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            mark = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if mark % 97 == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def plain_groups(counts):
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in counts}
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def result():
    return QUERIES["op12_spelling_variants"]


def test_query_against_sql(spark, duck, result):
    problem, rows = check(spark, duck, SMALL, result.run, result.sql)
    assert problem is None and rows > 100, problem


def test_counts_of_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = variants.word_counts(docs).collect()
    assert {r["word"]: r["n"] for r in rows} == plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()])


ODD = [(1, None), (2, ""), (None, "letter letter letter"), (3, "Übung übung Übung UEBUNG ÜBUNG÷×÷ 12 éééééé éééééé éééééé"),
       (4, "planet planets planed " * 9 + "planet " * 30), (4, "planet planets planed " * 9 + "planet " * 30), (5, ("q" * 40_000 + " ") * 4),
       (6, ("q" * 39_999 + "z ") * 3 + ("q" * 39_999 + " ") * 3), (7, "tenal planet lanet planet " * 3), (8, "ababa babab ababa babab ababa babab")]


@pytest.mark.parametrize("size", [1024, 2])
def test_odd_texts_and_small_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(variants, "BLOCK_WORDS", size)
    monkeypatch.setattr(variants, "KEPT_COUNTS", 3)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, n long, word string").repartition(4)
    rows = variants.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(r) for r in rows) == plain_groups(plain_counts(ODD))


def test_chains_and_ties(spark):
    counts = {"aaaaa": 64, "aaaab": 32, "aaabb": 16, "aabbb": 8, "abbbb": 4, "bbbbb": 3, "ccccc": 5, "ccccd": 10, "cccce": 10, "zzzzz": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = variants.grouped(words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(r) for r in rows) == plain_groups(counts)
    assert {r["word"]: r["root"] for r in rows}["abbbb"] == "aaaaa"
    assert {r["word"]: r["form"] for r in rows}["ccccc"] == "ccccd"


def test_every_pair_of_random_words(spark):
    import random

    draw = random.Random(5)
    counts = {"".join(draw.choice("abcéÿ") for _ in range(draw.randrange(5, 9))): draw.randrange(3, 50) for _ in range(900)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = [(r["word"], r["near"]) for r in variants.near_words(words).collect()]
    assert len(found) == len({frozenset(p) for p in found})
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in counts for b in counts if a < b and one_edit(a, b)}


def test_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.variants(spark.createDataFrame([(1, "once only here")], "doc_id long, text string")).count() == 0
