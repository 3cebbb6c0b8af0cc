"""Connected components of a distributed list of links, by alternating stars.

Every round replaces links by links to the smallest neighbour, first towards
larger nodes and then towards smaller ones, until the links are stars around the
smallest node of each component.  Minima are aggregates joined back, so that a
node with any number of links never meets one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpisleuth.llm.common import written


def _with_smallest(links: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u's neighbours.  The sides are dealt already, a broadcast would only pass through the driver."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` lead down.  A neighbour is linked to the smallest one, and that one's row links the node itself."""
    return _with_smallest(links).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _settled(stars: DataFrame) -> bool:
    """Every node has one parent, and no parent has one itself."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(
        stars.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where(
        "child > 1 OR (child > 0 AND parent > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links``: two id columns.  Returns (node, root) for every node but the roots themselves."""
    first, second = links.columns
    stars = links.select(F.col(first).cast("long").alias("u"), F.col(second).cast("long").alias("v")).where("u <> v")
    while True:
        large = written(_large_star(stars), "links")  # read twice
        stars = written(_small_star(large).distinct(), "links")
        if _settled(stars):
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
