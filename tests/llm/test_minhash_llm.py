from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from kpisleuth.llm import components, minhash
from kpisleuth.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= 5:
        return {tuple(words[i: i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    having: dict[tuple, list] = {}
    for i, s in sorted(sets.items()):
        shared: dict[int, int] = {}
        for g in s:
            for j in having.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            having[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert got(QUERIES["op2_minhash_near_dedup"].run(spark, SMALL)) == brute_force(docs)


def test_chains_and_hot_groups(spark):
    """Chains of drifting copies, hundreds of exact and near copies, short and empty texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for _ in range(40):  # each close to its neighbour, the ends aren't
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append(" ".join(base))
    hot = [rng.choice(words) for _ in range(80)]
    rows += ["  ".join(hot).upper()] * 150
    for _ in range(150):
        near = list(hot)
        near[rng.randrange(80)] = f"x{rng.randrange(999)}"
        rows.append("\n".join(near))
    rows += ["a b", "A  b", "a b c d", "a b c d e", "", " \t", None, "É é", "é é", "a b"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    frame = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, id int, n string").repartition(7)
    assert got(minhash.near_copies(frame)) == brute_force(rows)


def template_rows(rng, share, pages=240):
    """Ordinary copies, and pages of one template that alone is just too little; ``share`` pages have a passage in common."""
    fresh = lambda n: [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]
    rows = [" ".join(fresh(30)) for _ in range(300)] * 2
    template, passages, feet = fresh(174), [fresh(4) for _ in range(pages)], [fresh(6) for _ in range(3)]
    rows += [" ".join(template + (passages[i // share] if i < pages // 2 else fresh(4)) + fresh(21) + feet[i % 3]) for i in range(pages)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("share", [2, 24])
def test_pairs_in_a_bucket_of_a_template(spark, share, monkeypatch):
    """Similar pairs among members unlike every centre, however many other links there are."""
    monkeypatch.setattr(minhash, "SIDE", 100, raising=False)
    rows = template_rows(random.Random(share), share)
    want = brute_force(rows)
    assert len({c for _, c, _ in want.values()}) == 300 + 120 + 120 // share
    assert got(minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want


def test_blocks_prove_what_brute_force_does():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 70)) for _ in range(200)]
    table = pa.table({"set_id": pa.array(range(200), pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                      "root": pa.array([i if i < 100 else 100 for i in range(200)], pa.int64()), "hot": pa.array([s.tolist() for s in sets])})
    links = minhash._joined_by_blocks(60)(table).to_pylist()
    root = np.minimum(np.arange(200), 100)
    want = root.copy()
    for i in range(200):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                want[want == want[i]] = want[j]
    for link in links:
        root[root == root[link["a"]]] = root[link["b"]]
    assert links and len({*zip(root.tolist(), want.tolist(), strict=True)}) == len({*root.tolist()}) == len({*want.tolist()})


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five six"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None)]
    found = sorted(map(str, minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert len(found) == 6
    assert sum("component_id=1, kept=True" in f for f in found) == 2
    assert sum("component_id=None, kept=None" in f for f in found) == 2
    assert sum("component_id=3, kept=True" in f for f in found) == 1
    assert sum("doc_id=2" in f and "component_id=1, kept=False" in f for f in found) == 1


def test_empty_table(spark):
    assert minhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_estimates_similarity():
    np.seterr(over="ignore")
    rng = np.random.default_rng(0)
    errors = []
    for size in (3, 20, 200, 2000):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * size).astype(np.uint64))
            a, b = pool[: int(size * 1.5)], pool[size // 2:]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
    assert abs(np.mean(errors)) < 0.03


def test_components_of_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    frame = spark.createDataFrame(path + star + [(1005, 1006), (5, 4)], "a long, b long").repartition(5)
    found = {r["node"]: r["root"] for r in components.components(frame).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 300)}}


def test_links_of_earlier_rounds_are_read_as_stars(spark, monkeypatch):
    """However many rounds there were, components() reads three written tables at most."""
    seen, real = [], components.components

    def counted(links):
        seen.append(links._jdf.queryExecution().analyzed().toString().count("Relation "))
        return real(links)

    monkeypatch.setattr(minhash, "components", counted)
    monkeypatch.setattr(minhash, "SIDE", 100)
    rows = template_rows(random.Random(24), 24)
    assert got(minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute_force(rows)
    assert len(seen) >= 3 and max(seen) <= 3


def test_stars_do_not_pass_through_the_driver(spark):
    links = components.written(spark.createDataFrame([(3, 1), (3, 2), (4, 3)], "u long, v long"), "links")
    for star in (components._large_star(links), components._small_star(links)):
        assert "Broadcast" not in star._jdf.queryExecution().executedPlan().toString()
