"""Nearest neighbours by a forest of hash prefixes.

Every tree writes a vector as a long string of sign bits of random projections
and keeps the strings sorted.  A query descends each tree to its longest prefix
match, a range of the sorted strings; then all trees ascend together, one bit
shorter at a time, until the ranges together hold ``EFFORT`` of the block and
``EFFORT_EACH`` for each neighbour asked for.  The union of the ranges is scored
exactly in double precision.  Inner products are made angles first: a coordinate
that levels all norms of the block is appended to the vectors, and 0 to queries.

Vectors are dealt into blocks of about ``VECTOR_BLOCK`` rows with a forest each,
queries into blocks of about ``QUERY_BLOCK``; a task holds one block of either,
and the best of each block are merged.  Every row is indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite components,
and rows without id, take no part; vectors are compared with those of equal
length only; rows that share the query's id are its own row; other repeated rows
are candidates each; equal scores go to the smaller id; with fewer candidates
than asked, all are returned; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth.llm.common import written

TREES, DEPTH = 128, 24
EFFORT = 0.4  # of the block's size, repeats included
VECTOR_BLOCK, QUERY_BLOCK = 8192, 4096
EFFORT_EACH = 24  # more for each neighbour asked for, as they are a larger part of a small block

FOUND = "query_id long, vec_id long, score double"


def projections(dimension: int) -> np.ndarray:
    return np.random.default_rng(20_240 + dimension).normal(size=(dimension, TREES * DEPTH)).astype(np.float32)


def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash string of each vector in each tree: DEPTH bits, the first is the highest."""
    powers = (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64)).astype(np.int32)
    out = np.empty((TREES, len(vectors)), np.int32)
    for at in range(0, len(vectors), 1024):
        signs = (vectors[at: at + 1024].astype(np.float32) @ planes) > 0
        out[:, at: at + 1024] = (signs.reshape(len(signs), TREES, DEPTH) @ powers).T
    return out


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The k nearest found of each query in one block: (query ids, ids, scores)."""
    n, dimension = vectors.shape
    norms = (vectors * vectors).sum(axis=1)
    planes = projections(dimension + 1)
    keys = strings(np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]), planes)
    asked = strings(np.column_stack([queries, np.zeros(len(queries))]), planes)
    order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
    keys = np.take_along_axis(keys, order, axis=1)
    low = np.empty((DEPTH + 1, TREES, len(queries)), np.int32)
    high = np.empty_like(low)
    for level in range(DEPTH + 1):  # level: length of the common prefix
        shift = DEPTH - level
        for tree in range(TREES):
            prefix = asked[tree] >> shift
            low[level, tree] = np.searchsorted(keys[tree], prefix << shift)
            high[level, tree] = np.searchsorted(keys[tree], ((prefix + 1) << shift) - 1, side="right")
    held = (high - low).sum(axis=1, dtype=np.int64)  # level, query
    wanted = EFFORT * n + EFFORT_EACH * k
    out_q, out_v, out_s = [], [], []
    for q in range(len(queries)):
        level = int(np.flatnonzero(held[:, q] >= wanted).max(initial=0))
        while True:
            seen = np.zeros(n, bool)
            for tree in range(TREES):
                seen[order[tree, low[level, tree, q]: high[level, tree, q]]] = True
            seen &= ids != query_ids[q]
            near = np.flatnonzero(seen)
            if len(near) >= k or level == 0:
                break
            level -= 1
        if not len(near):
            continue
        rough = vectors[near] @ queries[q]
        if len(near) > k:
            edge = np.partition(rough, len(rough) - k)[len(rough) - k]
            near = near[rough >= edge - 1e-9 * max(1.0, abs(edge))]
        exact = (vectors[near] * queries[q]).sum(axis=1)  # the same order of addition for every row
        best = np.lexsort((ids[near], -exact))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_v.append(ids[near][best])
        out_s.append(exact[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_v, np.int64), (out_s, np.float64)))


def _cell(k: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows.column("id").to_numpy()
        asked = rows.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        values = rows.column("vector").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(len(ids), -1)
        sorting = np.lexsort((ids,))  # whatever order the rows came in
        ids, asked, vectors = ids[sorting], asked[sorting], vectors[sorting]
        if asked.all() or not asked.any():
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = search(ids[~asked], vectors[~asked], ids[asked], vectors[asked], k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})

    return run


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score."""
    def ready(frame):
        return frame.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull()).select(
            F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), F.size(vector_column).alias("dim"))

    base, asked = ready(vectors), ready(queries)
    n, q = base.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-q // QUERY_BLOCK))
    spread = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(query_blocks - 1))
    base = base.withColumns({"block": F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"), "asked": F.lit(False)}).withColumn(
        "query_block", F.explode(spread[1]))
    asked = asked.withColumns({"query_block": F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"), "asked": F.lit(True)}).withColumn(
        "block", F.explode(spread[0]))
    found = written(base.unionByName(asked).groupBy("dim", "block", "query_block").applyInArrow(_cell(k), FOUND), "forest-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
