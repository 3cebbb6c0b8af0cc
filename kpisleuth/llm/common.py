"""Helpers shared by the operators: tables, scratch tables, worker memory, folds."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpisleuth.session import shared_dir, written

__all__ = ["fold", "forget", "held_out", "labelled", "parts", "shared_dir", "sieved", "table", "worker_memory", "written"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """A row without an id is held out: nothing may be learned from it."""
    return F.coalesce(fold(column, modulus) == F.lit(remainder), F.lit(True))


SIEVE_BITS = 24  # 2 MB, whatever the number of keys


def sieved(frame: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``frame`` whose ``key`` may be among those of ``wanted``.

    The keys fill a bitmap of fixed size, which is broadcast.  Rows of other keys
    can pass by chance, more of them the fuller it is; no row of a wanted key is
    lost.  It spares a later join the shuffle of rows that have no partner.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << SIEVE_BITS))
    maps = wanted.where(F.col(key).isNotNull()).select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.col("p") % 32768).alias("__map"))
    marked = frame.where(F.col(key).isNotNull()).withColumn("__place", place).join(
        F.broadcast(maps), F.floor(F.col("__place") / 32768) == F.col("__bucket"))
    bit = F.col("__place") % 32768
    byte = F.conv(F.hex(F.substring("__map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return marked.where(F.call_function("shiftright", byte, (bit % 8).cast("int")) % 2 == 1).select(*frame.columns)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learnable: Column) -> DataFrame:
    """(doc_id, text, label) of the rows that may be learned from, written once.

    Texts without a label are sieved out before the join, and the join shuffles at
    every size, so its cost stays in proportion.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).dropDuplicates(["doc_id"])
    texts = docs.where(learnable).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(sieved(texts, "doc_id", known).join(known.hint("shuffle_hash"), "doc_id"), "labelled-texts")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_memory(name: str, make):
    """An object kept for the life of one Python worker.

    Functions travel to executors by value, so their module globals are made
    anew for each task; tables and caches worth keeping between tasks live in a
    module of their own.
    """
    store = sys.modules.setdefault("kpisleuth_worker_memory", types.ModuleType("kpisleuth_worker_memory"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def forget(prefix: str) -> None:
    """Give up what another operator has left in this worker's memory, so that the stages of a pipeline don't add up."""
    store = sys.modules.get("kpisleuth_worker_memory")
    for name in [n for n in vars(store) if n.startswith(prefix)] if store else []:
        delattr(store, name)
