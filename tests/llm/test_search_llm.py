"""Benchmark items in documents, nearest neighbours, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from kpisleuth.llm import decontaminate, forest
from kpisleuth.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def canonical(texts):
    return [t[:-1] for t in decontaminate.canonical(pa.array(texts, pa.string())).cast(pa.large_binary()).to_pylist()]


def edit_distance_within(item, text):
    """Smallest edit distance of ``item`` to any stretch of ``text``, by the plain recurrence."""
    row = np.zeros(len(text) + 1, np.int64)
    text = np.frombuffer(text, np.uint8)
    for i, ch in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        best = np.minimum(row[1:] + 1, row[:-1] + (text != ch))
        for j in range(1, len(row)):
            new[j] = min(best[j - 1], new[j - 1] + 1)
        row = new
    return int(row.min())


def edited(rng, item, k):
    out = bytearray(item)
    for _ in range(k):
        at, ch = rng.randrange(len(out)), rng.choice(b"abcdefghijklmnopqrst")
        if out[at] < 128:
            out[at: at + 1] = (bytes([ch]), b"", bytes([out[at], ch]))[rng.randrange(3)]
    return bytes(out).decode("utf-8", "ignore")


def test_query_finds_every_exact_item_and_nothing_far(spark):
    rows = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op6_benchmark_decontamination"].run(spark, LARGER).collect()}
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{LARGER}/benchmark.parquet").select("item_id", "text").collect()
    texts = dict(zip([d["doc_id"] for d in docs], canonical([d["text"] for d in docs]), strict=True))
    wanted = dict(zip([i["item_id"] for i in items], canonical([i["text"] for i in items]), strict=True))
    exact = {(d, i) for d, t in texts.items() for i, x in wanted.items() if x in t}
    assert exact and exact <= set(rows)
    assert all(rows[p]["edits"] == 0 for p in exact)
    for (d, i), r in rows.items():
        part = texts[d][max(0, r["stop"] - 2 * len(wanted[i])): r["stop"] + 40]
        assert edit_distance_within(wanted[i], part) == r["edits"] <= decontaminate.EDITS * len(wanted[i])


def test_recall_of_edited_copies(spark):
    """Copies with the most edits allowed, at random places of other texts."""
    rng = random.Random(8)
    hosts = [t for t in canonical([r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]) if len(t) > 500]
    items = spark.read.parquet(f"{LARGER}/benchmark.parquet")
    rows, want = [], []
    for n, (i, x) in enumerate((r["item_id"], canonical([r["text"]])[0]) for r in items.collect() for _ in range(6)):
        host = rng.choice(hosts)
        at = host.index(b" ", rng.randrange(300))
        rows.append((n, host[:at].decode("utf-8", "ignore") + " " + edited(rng, x, int(len(x) * decontaminate.EDITS)) + host[at:].decode("utf-8", "ignore")))
        want.append((n, i))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), items).collect()}
    assert np.mean([w in found for w in want]) >= 0.95


def test_odd_documents_and_items(spark):
    item = "Every good benchmark item holds a sentence, which nobody else would write by chance!"
    other = item.replace("nobody", "no person").replace("chance", "pure luck and habit of mind")
    docs = [(1, item), (1, item), (2, "x " * 50_000 + item.upper().replace(" ", "\n* ")), (3, None), (4, ""), (5, other), (None, f"pre {item} post"),
            (6, item[:-30]), (7, item + " " + item)]
    frame = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, item_id int, region string").repartition(3)
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, "too short", "x"), (3, None, "x"), (4, "", "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    found = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminated(frame, items).collect()), key=str)
    assert found == sorted([(1, 1, 0), (2, 1, 0), (None, 1, 0), (7, 1, 0)], key=str)
    assert decontaminate.contaminated(frame.limit(0), items).count() == decontaminate.contaminated(frame, items.limit(0)).count() == 0


def test_exact_copies_without_words(spark):
    """Space-free stretches, few and long words, and short items, bounded by spaces or not."""
    rng = random.Random(12)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = [han(rng.randrange(16, 60)) for _ in range(40)] + [han(20) + "，" + han(20) for _ in range(20)]
    items += [f"{rng.randrange(10 ** 25):025d} {rng.randrange(10 ** 23):023d}" for _ in range(20)] + ["short enough to say it", han(6), han(15)]
    rows, want = [], set()
    for i, item in enumerate(items):
        for k, (before, after) in enumerate(((" ", " "), ("", ""), (" " * rng.randrange(1, 4), "。"))):
            host = " ".join(han(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 30)))
            rows.append((3 * i + k, f"{host}{before}{item}{after}{han(50)}"))
            want.add((3 * i + k, i, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found.collect()} == want


def test_seeds_of_a_stretch_are_seeds_of_its_text():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 5000).astype(np.uint8)
    everywhere = set(decontaminate.seeds(text)[0].tolist())
    for at in range(0, 4900, 7):
        places, _ = decontaminate.seeds(text[at: at + decontaminate.SHORTEST])
        assert len(places) and {at + int(x) for x in places} <= everywhere


def test_best_stretch_equals_plain_recurrence():
    rng = random.Random(1)
    for _ in range(60):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randrange(5, 40)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 80)))
        true = edit_distance_within(item, text)
        got = decontaminate.best_stretch(item, text, len(item))
        assert got is not None and got[0] == true
        assert decontaminate.best_stretch(item, text, true - 1) is None


# --- nearest neighbours ---


def brute(rows, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in usable:
        if q % 20:
            continue
        scored = sorted((-float((np.array(y) * x).sum()), i) for i, y in usable if i != q and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_recall_and_scores(spark, folder):
    rows = QUERIES["op7_hash_prefix_forest"].run(spark, folder).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(vectors, 20)
    pairs = {(q, i): s for q, _, i, s in want}
    hit = sum((r["query_id"], r["vec_id"]) in pairs for r in rows)
    assert len(rows) == len(want) and hit >= 0.9 * len(want)
    assert all(abs(r["score"] - pairs.get((r["query_id"], r["vec_id"]), r["score"])) < 1e-12 for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert all(x == sorted(x) for x in by.values())


def test_many_blocks_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + 0.1 * rng.normal(size=16)).tolist()) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(forest, "VECTOR_BLOCK", 200)
    monkeypatch.setattr(forest, "QUERY_BLOCK", 30)
    got = {(r["query_id"], r["vec_id"]) for r in forest.nearest(frame, frame.where("vec_id % 20 = 0"), 10).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 10)}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 2.0]), (None, [1.0, 1.0]), (40, [-1.0, 1.0]), (0, [1.0, 0.0]), (60, [1.0])]
    frame = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(4)
    got = [tuple(r) for r in forest.nearest(frame, frame.where("vec_id % 20 = 0").dropDuplicates(["vec_id"]), 20).collect()]
    by = {q: [(r, v, s) for x, r, v, s in sorted(got) if x == q] for q in (0, 20, 40, 60)}
    assert by[0] == [(1, 1, 2.0), (2, 2, 2.0), (3, 40, -1.0)]
    assert by[20] == [(1, 9, 11.0)] and by[60] == []
    assert [v for _, v, _ in by[40]] == [0, 0, 1, 2]
    assert forest.nearest(frame.limit(0), frame.limit(0), 20).count() == 0


# --- the pipeline ---


def test_pipeline_against_its_operators_by_brute_force(spark):
    """Each stage's decision on each stage's own input, recomputed without Spark."""
    import corpus_pipeline
    from test_minhash_llm import brute_force
    from test_packing_llm import PATH, check_sequences, expected

    from kpisleuth.llm.common import written

    assert public_path() == PATH
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 ## 34", "en", "s", 8), (90_003, "", None, None, None)], docs.schema)
    docs = docs.union(extra)
    seen = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = written(stage(spark, docs, SMALL), "test-stage")
        assert new.columns == docs.columns and [f.dataType for f in new.schema] == [f.dataType for f in docs.schema]
        rows = {r["doc_id"]: r for r in new.collect()}
        assert len(rows) == new.count()
        if name == "language ID":
            assert set(seen) - set(rows) == {90_001, 90_002, 90_003} and all(rows[i] == seen[i] for i in rows)
        elif name == "MinHash near-dedup":
            assert set(rows) == {i for i, (_, _, kept) in brute_force([(i, r["text"]) for i, r in seen.items()]).items() if kept}
        elif name == "benchmark decontamination":
            items = canonical([r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
            texts = dict(zip(seen, canonical([r["text"] for r in seen.values()]), strict=True))
            exact = {i for i, t in texts.items() if any(x in t for x in items)}
            assert exact and not exact & set(rows)
            assert all(any(edit_distance_within(x, t) <= decontaminate.EDITS * len(x) for x in items) for t in [texts[i] for i in set(seen) - set(rows) - exact])
        else:
            assert set(rows) == set(seen) and any(rows[i]["text"] != seen[i]["text"] for i in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        docs, seen = new, rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sorted((tuple(r[:5]) for r in packed), key=str) == expected([(i, r["text"]) for i, r in seen.items()])
    check_sequences(packed)
    assert sorted(tuple(r[:5]) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(tuple(r[:5]) for r in packed)


def public_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
