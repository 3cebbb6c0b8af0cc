"""Centroid clustering in whole numbers by a bisector tournament.

A vector lies nearer to centroid b than to centroid a exactly where a linear form is
positive: twice its product with b - a, less |b|^2 - |a|^2.  These normals and
thresholds are made once a round for every pair a < b.  Each vector then plays
k - 1 such tests, the winner so far against the next number; zero leaves the smaller
number in.  Only the winner's distance is computed.  Everything is exact: components
become whole numbers first, and products stay below 2**53 in doubles or, for large
components, below 2**63 in 64-bit integers.

Every task adds up its own vectors by cluster and component; Spark adds these partial
sums, and only k times d of them reach the driver.  Normals are made in the tasks from
the k centroids, which is all that is sent to them; they take k * k * d numbers there.

Defined cases: a vector takes part if it has an id and exactly ``dim`` components, none
null, NaN or infinite, and every scaled component is within 2**27 (beyond that a
squared distance does not fit 64 bits).  Rows with the same id and vector are vectors
of their own; those with the same hash start in the order of their components.  Fewer
vectors than k give as many clusters; an empty table gives no rows.  Equal centroids:
the smaller number takes all.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import written

CLUSTERS = 40
ROUNDS = 5
DIM = 64
SCALE = 256
SEED = 2
LARGEST = 1 << 27

Centroids = list[list[int]]


def whole_numbers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_column: str = "vec_id",
                  vector_column: str = "embedding") -> DataFrame:
    """(vec_id, point): floor(scale * x) of every component of the vectors that take part."""
    point = F.transform(F.col(vector_column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = ~F.exists(vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * float(scale)) > float(LARGEST - 1)))
    return vectors.where(F.col(id_column).isNotNull() & (F.size(vector_column) == dim) & fits).select(
        F.col(id_column).cast("long").alias("vec_id"), point.alias("point"))


def first_centroids(points: DataFrame, k: int, seed: int = SEED) -> Centroids:
    """The k points whose id has the smallest hash."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["point"]) for r in points.select(mark.alias("mark"), "point").orderBy("mark", "point").limit(k).collect()]


class Bisectors:
    """Normals and thresholds of all pairs of centroids, and the tournament."""

    def __init__(self, centroids: Centroids):
        self.centroids = c = np.asarray(centroids, dtype=np.int64)
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        squares = np.einsum("kd,kd->k", c, c)
        self.thresholds = squares[None, :] - squares[:, None]
        self.size = int(np.abs(c).max(initial=0))
        self.doubles = self.normals.astype(np.float64), self.thresholds.astype(np.float64)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of each point."""
        size, dim = int(np.abs(points).max(initial=0)), points.shape[1]
        normals, thresholds = self.normals, self.thresholds
        if 4 * dim * max(size, 1) * max(self.size, 1) < 1 << 52 and 2 * dim * self.size ** 2 < 1 << 52:  # doubles hold every sum
            points, (normals, thresholds) = points.astype(np.float64), self.doubles
        winner = np.zeros(len(points), np.int64)
        for rival in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", points, normals[winner, rival]) - thresholds[winner, rival]
            winner[side > 0] = rival
        return winner

    def distances(self, points: np.ndarray, winner: np.ndarray) -> np.ndarray:
        apart = points - self.centroids[winner]
        return np.einsum("nd,nd->n", apart, apart)


def _points(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def cluster_sums(points: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Number of points of each cluster and their exact sum by component."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors, counts, sums = Bisectors(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:  # a task holds fewer than 2**36 points, so a sum fits
            values = _points(batch.column(0), dim)
            winner = bisectors.nearest(values)
            counts += np.bincount(winner, minlength=k)
            np.add.at(sums, winner, values)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int64()), pa.array(counts[met], pa.int64()), pa.array(sums[met].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])

    exact = "decimal(38,0)"
    rows = points.select("point").mapInArrow(run, "cluster long, n long, sums array<long>").select(
        "cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(
        F.sum(F.col("part").cast(exact)).alias("total"), F.sum("n").alias("n")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        found.setdefault(r["cluster"], (r["n"], [0] * dim))[1][r["place"]] = int(r["total"])
    return found


def moved(centroids: Centroids, sums: dict[int, tuple[int, list[int]]]) -> Centroids:
    """Centroids at the floor of their mean; those without points stay."""
    return [[total // sums[c][0] for total in sums[c][1]] if c in sums else old for c, old in enumerate(centroids)]


def assigned(points: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance) of every point."""
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bisectors = Bisectors(centroids)
        for batch in batches:
            values = _points(batch.column(1), dim)
            winner = bisectors.nearest(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(winner, pa.int32()), pa.array(bisectors.distances(values, winner), pa.int64())],
                ["vec_id", "cluster", "distance"])

    return points.select("vec_id", "point").mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED,
              id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its final components)."""
    spark = vectors.sparkSession
    points = written(whole_numbers(vectors, dim, scale, id_column, vector_column), "cluster-points")
    centroids = first_centroids(points, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(points, centroids))
    found = written(assigned(points, centroids), "cluster-members")
    parts = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # k rows
    inertia = int(sum(parts.values()))
    totals = spark.createDataFrame([(c, int(parts[c]), inertia, centroids[c]) for c in parts],
                                   "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)


def clusters_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same by plain distances to every centroid, one step after another."""
    steps = [f"""
points AS MATERIALIZED (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor({scale}.0::DOUBLE * x::DOUBLE)::BIGINT) AS p, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {dim}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs({scale}.0::DOUBLE * x::DOUBLE) > {LARGEST - 1})) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), p) - 1)::INTEGER AS c, p
  FROM points QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), p) <= {k})"""]
    near = """
a{i} AS MATERIALIZED (
  SELECT r, vec_id, p, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, vec_id, v.p AS p, c, list_sum(list_transform(list_zip(v.p, m.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM points v CROSS JOIN c{i} m)
  GROUP BY r, vec_id, p)"""
    for i in range(rounds):
        steps.append(near.format(i=i))
        steps.append(f"""
s{i} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS p
  FROM (SELECT c, place, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
        FROM (SELECT c, unnest(p) AS x, generate_subscripts(p, 1) AS place FROM a{i}) GROUP BY c, place) GROUP BY c),
c{i + 1} AS MATERIALIZED (
  SELECT m.c, coalesce(s.p::BIGINT[], m.p) AS p FROM c{i} m LEFT JOIN s{i} s ON s.c = m.c)""")
    steps.append(near.format(i=rounds))
    return f"""WITH {','.join(steps)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""
