from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from compare import check
from conftest import SMALL
from pyspark.sql import functions as F

from kpisleuth.llm import tournament
from kpisleuth.llm.queries import QUERIES


def plain(rows, k, rounds, dim):
    """The same with Python integers and every distance."""
    points = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
              if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), p) for i, p in points)[:k]
    centroids = [p for _, p in start]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members: dict = {}
        for _, p in points:
            members.setdefault(nearest(p)[1], []).append(p)
        centroids = [[sum(col) // len(members[n]) for col in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(p))) for i, p in points]
    inertia = {n: sum(d for _, c, d in found if c == n) for n in range(len(centroids))}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, inertia[c], sum(inertia.values()), marks[c]) for i, c, d in found)


def run(frame, **parameters):
    rows = tournament.clustered(frame, **parameters).withColumn("mark", tournament.centroid_digest(F.col("centroid"))).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "mark").collect()
    return sorted(tuple(r) for r in rows)


def test_query_against_sql(spark, duck):
    query = QUERIES["op13_centroid_tournament"]
    problem, rows = check(spark, duck, SMALL, query.run, query.sql)
    assert problem is None and rows == 500, problem


NAN, INF = float("nan"), float("inf")
ODD = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [0.25, None]), (3, None), (4, []), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, 2.0, 3.0]),
       (None, [1.0, 1.0]), (8, [-0.001, 0.001]), (9, [0.0, 0.0]), (10, [-3.7, 2.2]), (11, [1000.0, -1000.0]), (12, [-3.7, 2.25])]


@pytest.mark.parametrize("k", [1, 3, 40])
def test_odd_vectors(spark, k):
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in ODD], "vec_id long, embedding array<float>, cluster int, point int, distance string")
    got = run(frame.repartition(3), k=k, dim=2)
    assert got == plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in ODD], k, 5, 2)


def test_too_large_components_take_no_part(spark):
    rows = [(1, [1e300, 0.0]), (2, [1e5, -1e5]), (3, [5e5, 5e5]), (4, [0.0, 1.0])]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, dim=2)
    assert got == plain(rows[1:], 2, 5, 2)


def test_empty_table(spark):
    empty = tournament.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


@pytest.mark.parametrize("size", [3, 1 << 26])
def test_tournament_equals_all_distances(size):
    draw = np.random.default_rng(1)
    centroids = draw.integers(-size, size + 1, (9, 5))
    centroids[4] = centroids[2]
    points = np.concatenate([draw.integers(-size, size + 1, (500, 5)), centroids, (centroids[:1] + centroids[1:2]) // 2])
    squared = ((points[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(axis=2)
    bisectors = tournament.Bisectors(centroids.tolist())
    winner = bisectors.nearest(points)
    assert winner.tolist() == squared.argmin(axis=1).tolist()
    assert bisectors.distances(points, winner).tolist() == squared.min(axis=1).tolist()
