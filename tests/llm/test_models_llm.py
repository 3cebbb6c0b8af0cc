"""Classifiers: held-out accuracy, exactness of their parts, odd rows."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kpisleuth.llm import langid, quality, toxicity
from kpisleuth.llm.common import held_out
from kpisleuth.llm.queries import QUERIES
from kpisleuth.llm.wordhash import SPACE, Words

LARGER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 ### 4.5"), (4, "the of and"), (4, "the of and"), (None, "the of and"), (5, "word " * 60_000), (6, "\U0001f600 é ß")]


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", held_out("doc_id", 4, 2).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is None or fold(r["doc_id"], 4) == 2) for r in rows)


def test_language_query(spark):
    rows = QUERIES["op3_language_id"].run(spark, LARGER).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert len(rows) == len(lang) and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def test_language_reads_only_the_text(spark):
    model = langid.train(np.stack([langid.windows(np.frombuffer(t, np.uint8))[0] for t in (b"the and of", b"le la les des")]), np.array([0, 1]), ["en", "fr"])
    frame = spark.createDataFrame([(i, t, "xx", 9.0) for i, t in ODD], "doc_id long, text string, lang string, score double").repartition(3)
    rows = langid.classify(frame, model).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3))
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in langid.classify(frame, None).collect()} == {"und"}
    assert langid.classify(frame.limit(0), model).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs, ~held_out("doc_id", 4, 2)) is None


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(1)
    model = langid.train(rng.integers(0, 256, (8, langid.WINDOW + 3)).astype(np.uint8), np.arange(8) % 3, ["a", "b", "c"])
    text = rng.integers(1, 256, 700).astype(np.uint8)
    rows = langid.windows(text)
    padded = np.concatenate([text, np.zeros(len(rows) * langid.WINDOW + 3 - len(text), np.uint8)])
    for i, got in enumerate(model.log_probabilities(rows)):
        peaks = [max(sum(f[k, padded[i * langid.WINDOW + t + k], c] for k in range(len(f))) for t in range(langid.WINDOW))
                 for f in model.filters for c in range(langid.FILTERS)]
        score = np.maximum(np.array(peaks) + model.bias, 0) @ model.out + model.out_bias
        assert np.allclose(got, score - np.log(np.exp(score).sum()), atol=1e-3)


def test_toxicity_query(spark, labels):
    rows = QUERIES["op4_toxicity_crf"].run(spark, LARGER).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in rows if r["doc_id"] in labels]
    assert np.mean([p == t for p, t in known]) > 0.93
    clean = [p for p, t in known if t == 0]
    assert np.mean(clean) < 0.02
    for r in rows:
        text = docs[r["doc_id"]].lower().encode()
        for span in r["spans"]:
            assert text[span["start"]: span["stop"]].decode().strip()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = toxicity.Field(np.zeros(4), rng.normal(size=(2, 2)), np.zeros(3))
    emission = rng.normal(size=(3, 6))
    real = np.ones((3, 6), bool)
    real[1, 4:] = False
    chance, pairs = field.marginals(emission, real, expected=True)
    total = np.zeros((2, 2))
    for i in range(3):
        n = int(real[i].sum())
        weights, tags = [], list(itertools.product((0, 1), repeat=n))
        for t in tags:
            weights.append(np.exp(sum(emission[i, k] * t[k] for k in range(n)) + sum(field.moves[a, b] for a, b in itertools.pairwise(t))))
        weights = np.array(weights) / sum(weights)
        for k in range(n):
            assert np.isclose(chance[i, k], sum(w for w, t in zip(weights, tags, strict=True) if t[k]))
        for w, t in zip(weights, tags, strict=True):
            for a, b in itertools.pairwise(t):
                total[a, b] += w
        assert not chance[i, n:].any()
    assert np.allclose(pairs, total)


def test_odd_rows_are_scored(spark):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, spans string, predicted int").repartition(2)
    rng = np.random.default_rng(0)
    field = toxicity.Field(rng.normal(-1, 0.2, 1 << toxicity.BITS).astype(np.float32), np.zeros((2, 2)), np.array([0.0, 1.0, 1.0]))
    rows = toxicity.score(frame, field, held_out("doc_id", 5, 0)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (4, None)}) == 1
    assert {r["score"] for r in toxicity.score(frame, None, held_out("doc_id", 5, 0)).collect()} == {0.0}
    model = quality.Margin(np.ones(1 << quality.BITS, np.float32), rng.normal(size=1 << quality.BITS).astype(np.float32), 0.1, (0.0, 1.0))
    rows = quality.score(frame, model, held_out("doc_id", 5, 0)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(frame.limit(0), field, held_out("doc_id", 5, 0)).count() == quality.score(frame.limit(0), model, held_out("doc_id", 5, 0)).count() == 0


def test_one_class_alone(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(9)], "doc_id long, text string")
    ones = spark.createDataFrame([(i, 1, 1) for i in range(9)] + [(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, ones, ~held_out("doc_id", 5, 0)) is None
    assert quality.fit(docs, ones, ~held_out("doc_id", 5, 0)) == 1.0
    assert quality.fit(docs, ones.limit(0), ~held_out("doc_id", 5, 0)) == 0.0


def test_quality_query(spark, labels):
    rows = QUERIES["op5_quality_nbsvm"].run(spark, LARGER).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]["quality"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and np.mean([p == t for p, t in held]) > 0.95


def test_dual_descent_meets_its_conditions():
    """At the optimum no example can lower the dual further."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(120)]
    values = [rng.normal(size=len(r)) for r in rows]
    signs = np.where(rng.random(120) < 0.5, 1.0, -1.0)
    weights, bias = quality.dual_descent(rows, values, signs, np.full(120, 0.5), 40, epochs=2000)
    loss = np.array([max(0, 1 - s * (weights[r] @ v + bias)) for r, v, s in zip(rows, values, signs, strict=True)])
    primal = 0.5 * (weights @ weights + bias * bias) + 0.5 * loss.sum()
    from itertools import product
    for step, axis in product((1e-2, -1e-2), range(40)):
        moved = weights.copy()
        moved[axis] += step
        other = np.array([max(0, 1 - s * (moved[r] @ v + bias)) for r, v, s in zip(rows, values, signs, strict=True)])
        assert 0.5 * (moved @ moved + bias * bias) + 0.5 * other.sum() >= primal - 1e-3


def test_features_are_those_of_single_texts():
    texts = ["Ab cd!! cd!! 12 é", "", None, "x", "a b c d e f", "Ab cd!! cd!! 12 é"]
    together = list(quality.feature_sets(pa.array(texts, pa.string())))
    for t, found in zip(texts, together, strict=True):
        assert np.array_equal(next(quality.feature_sets(pa.array([t], pa.string()))), found)
    assert len(together[1]) == len(together[2]) == 0 and np.array_equal(together[0], together[5])


def test_words_of_a_chunk():
    texts = [b"The the  THE", b"", b" ", b"a\tb", b"ab", b"the"]
    offsets = np.cumsum([0, *[len(t) for t in texts]])
    found = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, gaps=SPACE)
    h = found.hash(found.starts, found.ends)
    assert np.diff(found.rows).tolist() == [3, 0, 0, 2, 1, 1]
    assert h[0] == h[1] == h[2] == h[6] and len(set(h[3:6].tolist())) == 3


def test_sieve_keeps_every_wanted_row(spark, monkeypatch):
    from kpisleuth.llm import common

    frame = spark.range(5000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id END AS doc_id", "id AS other")
    wanted = spark.range(0, 5000, 7).selectExpr("id AS doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    found = {r["doc_id"] for r in common.sieved(frame, "doc_id", wanted).collect()}
    assert {i for i in range(0, 5000, 7) if i % 50} <= found and len(found) < 900
    monkeypatch.setattr(common, "SIEVE_BITS", 15)  # nearly full: more pass, none is lost
    assert {i for i in range(0, 5000, 7) if i % 50} <= {r["doc_id"] for r in common.sieved(frame, "doc_id", wanted).collect()}
    assert common.sieved(frame, "doc_id", wanted.limit(0)).count() == 0
