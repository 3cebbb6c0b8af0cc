"""Near copies: one-permutation MinHash with optimal densification, bands, star edges.

Each distinct shingle is hashed once; the top bits of the hash choose one of
``BINS`` bins and a bin keeps its smallest value.  Empty bins borrow from a bin
picked by a hash of their own number, tried until it is filled.  Runs of
``ROWS`` bins are band keys.  Texts with the same shingle set form one class;
only class representatives go on.  Within a bucket each member is a candidate
of the bucket's centre only, so that a bucket of n members has n - 1 candidates.
Candidates are confirmed on full shingle sets.  Where members of one bucket are
still in different components, further rounds choose other centres, until a
round adds hardly any link.  What is still open then is settled exactly: similar
sets share one of their rarest shingles, so members that share one held by few
are paired by a join; similarity that rests on shingles held by many is found
among equal such parts by their smallest set, and among unequal ones by counting
all pairs of a bucket, dealt in blocks.  So no pair that shares a bucket is lost.

Defined cases: a null or empty text, or one of white space only, has an empty
set and is linked with nothing; a row with a null id gets null component and
kept; rows that share an id are placed each by its own text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import forget, worker_memory, written
from kpisleuth.llm.components import components
from kpisleuth.llm.wordhash import chunks, columns, mix, salts, words

SHINGLE = 5
BINS, ROWS = 128, 4
SIMILAR_PERCENT = 75
TRIES = 1024
NEW_CENTRES = 3  # of a bucket that is still in several components, each round
YIELD = 500  # rounds go on while one adds more than a link for so many known ones
FEW = 16  # members of open buckets that hold a rare shingle, at most
SIDE = 1024  # members in a block of an open bucket


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = columns(texts)
    factors = salts(size + 1, 11)
    for first, last in chunks(offsets):
        hashes, rows = words(data, offsets[first: last + 1])
        n = len(hashes) - size + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(size):
            if n > 0:
                grams += hashes[k: k + n] * factors[k]
        grams = mix(grams)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a: b - size + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    whole = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + factors[size] * np.uint64(b - a)
                yield mix(np.asarray([whole]))
            else:
                yield np.zeros(0, np.uint64)


def _donors(bins: int) -> np.ndarray:
    """Which bins an empty bin asks, in order."""
    asked = mix(np.arange(bins * TRIES, dtype=np.uint64) + np.uint64(0xA5A5) * np.uint64(bins + 1))
    return (asked % np.uint64(bins)).astype(np.int64).reshape(bins, TRIES)


def signature(found: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash of each bin, empty bins densified.  ``found`` is sorted and not empty."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    edges = np.searchsorted(found, np.arange(bins, dtype=np.uint64) << shift)
    ends = np.append(edges[1:], len(found))
    filled = ends > edges
    out = np.zeros(bins, np.uint64)
    out[filled] = found[edges[filled]]
    if not filled.all():
        donors = worker_memory(f"donors{bins}", lambda: _donors(bins))
        empty = np.flatnonzero(~filled)
        for few in (16, TRIES):
            able = filled[donors[empty, :few]]
            hit = able.any(axis=1)
            out[empty[hit]] = out[donors[empty[hit], able[hit].argmax(axis=1)]]
            empty = empty[~hit]
            if not len(empty):
                break
        if len(empty):  # all tries failed: the next filled bin in cyclic order
            there = np.flatnonzero(filled)
            out[empty] = out[there[np.searchsorted(there, empty) % len(there)]]
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signatures.shape[1] // rows
    parts = signatures.reshape(len(signatures), bands, rows) * salts(rows, 23)
    return mix(parts.sum(axis=2, dtype=np.uint64) + salts(bands, 29))


def set_number(found: np.ndarray) -> np.uint64:
    """Name of a shingle set: 64 bits of its size and two sums over its hashes."""
    with np.errstate(over="ignore"):
        sums = np.asarray([found.sum(dtype=np.uint64), mix(found + np.uint64(1)).sum(dtype=np.uint64), np.uint64(len(found))])
        return mix(mix(sums) + salts(3, 31)).sum(dtype=np.uint64)


SKETCH = "doc_id long, n_shingles long, set_id long, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    forget("tokens:")
    bands = BINS // ROWS
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            n = part.num_rows
            counts, names, signs = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros((n, BINS), np.uint64)
            for i, found in enumerate(shingle_sets(part.column(1))):
                counts[i] = len(found)
                if len(found):
                    names[i], signs[i] = set_number(found), signature(found)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands),
                                            pa.array(band_keys(signs).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(names.view(np.int64)), keys],
                names=["doc_id", "n_shingles", "set_id", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    forget("tokens:")
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            found = list(shingle_sets(part.column(1)))
            names = np.array([set_number(f) for f in found], np.uint64)
            ends = np.cumsum([0] + [len(f) for f in found])
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))],
                names=["set_id", "shingles"])


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("set_1"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("set_2"))
    both = edges.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_1", "set_2"))
    return both.where(F.lit(100) * shared >= F.lit(percent) * (F.size("set_1") + F.size("set_2") - shared)).select("a", "b")


def _still_open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets with three or more members that are in several components."""
    placed = buckets.where("members > 2").join(roots, F.col("set_id") == F.col("node"), "left").select(
        "key", "set_id", "n", F.coalesce("root", "set_id").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return placed.join(several, "key")


def _joined_by_blocks(percent: int):
    """Links among the rows of two blocks of a bucket that the counted shingles alone prove; as many as join components."""
    def run(table: pa.Table) -> pa.Table:
        ids, sizes = (table.column(c).to_numpy() for c in ("set_id", "n"))
        _, label = np.unique(table.column("root").to_numpy(), return_inverse=True)
        lists = table.column("hot").combine_chunks()
        _, gram = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        order = np.argsort(gram, kind="stable")
        gram, owner = gram[order], owner[order]
        left = np.flatnonzero(label != np.bincount(label).argmax())  # the largest component meets the others only
        shared = np.zeros((len(left), len(ids)), np.float32)
        for first in range(0, int(gram[-1]) + 1 if len(left) else 0, 4096):
            a, b = np.searchsorted(gram, [first, first + 4096])
            held = np.zeros((len(ids), 4096), np.float32)
            held[owner[a:b], gram[a:b] - first] = 1
            shared += held[left] @ held.T
        out: list[tuple[int, int]] = []
        for i, row in zip(left.tolist(), shared, strict=True):
            near = np.flatnonzero((row * (100 + percent) >= percent * (sizes + sizes[i])) & (label != label[i]))
            if len(near):
                others, at = np.unique(label[near], return_index=True)
                out += [(int(ids[i]), int(ids[j])) for j in near[at]]
                label[np.isin(label, others)] = label[i]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def _rest(buckets: DataFrame, sets: DataFrame, roots: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Roots after every pair of different components that shares a bucket has been settled."""
    still = written(_still_open(buckets, roots), "near-open")
    if still.isEmpty():
        return roots
    grams = sets.join(still.select("set_id", "n", "root").distinct(), "set_id").select("set_id", "n", "root", F.explode("shingles").alias("gram"))
    few = grams.groupBy("gram").agg(F.count("*").alias("held")).where(F.col("held") <= FEW)
    parts = written(grams.join(few, "gram", "left").groupBy("set_id", "n", "root").agg(
        F.sort_array(F.collect_list(F.when(F.col("held").isNotNull(), F.struct("held", "gram")))).alias("cold"),
        F.sort_array(F.collect_list(F.when(F.col("held").isNull(), F.col("gram")))).alias("hot")), "near-parts")
    # Similar sets share one of the n - ceil(n * percent / 100) + 1 rarest shingles of each.
    rarest = F.slice("cold", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    posts = written(parts.select("set_id", "n", "root", F.explode(F.filter(rarest, lambda g: g["held"] > 1)).alias("g")).select(
        "set_id", "n", "root", "g.gram"), "near-posts")
    other = posts.select("gram", F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    near = (F.col("set_id") < F.col("b")) & (F.col("root") != F.col("root_b")) & (
        F.lit(100) * F.least("n", "n_b") >= F.lit(percent) * F.greatest("n", "n_b"))
    pairs = posts.join(other, (posts["gram"] == other["gram"]) & near).select(F.col("set_id").alias("a"), "b").distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "near-edges")
    links = written(_confirmed(pairs, sets, percent), "near-links")
    # Pairs without a rare shingle in common share shingles held by many alone, and at least ``percent`` of each set.
    hot = parts.where(F.lit(100) * F.size("hot") >= F.lit(percent) * F.col("n")).select("set_id", "n", "root", "hot", F.xxhash64("hot").alias("name"))
    centres = hot.groupBy("name").agg(F.min(F.struct("n", "set_id", "root")).alias("c"))
    equal = hot.join(centres, "name").where(F.lit(100 + percent) * F.size("hot") >= F.lit(percent) * (F.col("n") + F.col("c.n")))
    links = links.union(written(equal.where("root <> c.root").select(F.col("set_id").alias("a"), F.col("c.set_id").alias("b")), "near-links"))
    roots = components(roots.union(links))
    placed = written(still.select("key", "set_id").join(hot.select("set_id", "n"), "set_id").join(
        roots, F.col("set_id") == F.col("node"), "left").select("key", "set_id", "n", F.coalesce("root", "set_id").alias("root")), "near-open")
    dealt = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / SIDE).alias("blocks")).where("lo < hi")
    cut = placed.join(dealt.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks")).withColumn(
        "with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "set_id", "n", "root")
    found = written(cut.join(hot.select("set_id", "hot"), "set_id").groupBy("key", "first", "second").applyInArrow(
        _joined_by_blocks(percent), "a long, b long"), "near-links")
    return roots if found.isEmpty() else components(roots.union(found))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                percent: int = SIMILAR_PERCENT) -> DataFrame:
    """Component of each document under the relation 100 * shared >= percent * union of shingle sets."""
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sketches = written(docs.mapInArrow(_sketches, SKETCH), "near-sketches")
    known = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "near-classes")
    exploded = classes.select("set_id", "rep", "n", F.posexplode("bands").alias("band", "key"))
    keyed = exploded.select("set_id", "rep", "n", F.xxhash64("band", "key").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = written(keyed.join(shared, "key"), "near-buckets")
    members = buckets.select(F.col("rep").alias("id")).distinct()
    sets = written(docs.join(members.hint("shuffle_hash"), "id", "left_semi").mapInArrow(
        _sets, "set_id long, shingles array<long>").dropDuplicates(["set_id"]), "near-sets")
    buckets = buckets.drop("rep")
    tested = roots = None
    known_links, turn = 0, -1
    while True:
        turn += 1
        if turn == 0:
            open_buckets, orders = buckets, [F.struct(F.xxhash64("set_id"), "set_id", "n")]
        else:  # only buckets with three or more members that are still in several components
            open_buckets = written(_still_open(buckets, roots), "near-open")  # read twice
            orders = [F.struct(F.xxhash64("set_id", "key", F.lit(turn), F.lit(k)), "set_id", "n", "root") for k in range(NEW_CENTRES)]
        centres = open_buckets.groupBy("key").agg(F.array(*[F.min(o) for o in orders]).alias("c")).select("key", F.explode("c").alias("c"))
        pairs = open_buckets.join(centres, "key").where("set_id <> c.set_id")
        if turn:
            pairs = pairs.where("root <> c.root")
        edges = pairs.where(F.lit(100) * F.least("n", "c.n") >= F.lit(percent) * F.greatest("n", "c.n")).select(
            F.least("c.set_id", "set_id").alias("a"), F.greatest("c.set_id", "set_id").alias("b")).distinct()
        if tested is not None:
            edges = edges.join(tested, ["a", "b"], "left_anti")
        edges = written(edges, "near-edges")
        if turn and edges.isEmpty():
            break
        tested = edges if tested is None else tested.union(edges)
        found = written(_confirmed(edges, sets, percent), "near-links")
        new_links = found.count()
        if turn and not new_links:
            break
        roots = components(found if roots is None else roots.union(found))
        known_links += new_links
        if turn and new_links * YIELD <= known_links:
            break
    roots = _rest(buckets, sets, roots, tested, percent)
    placed = classes.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "rep", F.coalesce("root", "set_id").alias("root"))
    names = placed.groupBy("root").agg(F.min("rep").alias("component"))
    named = placed.join(names, "root").select("set_id", "component")
    return sketches.join(named, "set_id", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
        .alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
