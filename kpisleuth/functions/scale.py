"""Order statistics that never gather one group into one task.

A plain window or ``percentile`` sends a whole group to a single task.  Here a
group is first reduced to (value, count) pairs with map-side combining.  The
pairs are dealt by range of (group, value), with boundaries that Spark samples
from the data, and written once, so that the ranges stay what they are if a task
is repeated.  Windows run inside one (group, range), and the totals of the
ranges - a small table - supply the offset of each.  Infinities and NaN are
values like others; NaN is the largest, as in Spark's ordering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth.session import written


def cumulative_counts(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct value with ``n`` and the rows strictly below it.

    Rows count once, or ``weight`` times when already counted.  Output: group
    columns, ``value``, ``n``, ``n_below``, ``n_total``; nulls are left out.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value)).agg(size.alias("n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(
        counts.repartitionByRange(ranges, *group, value).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    by_range = dealt.groupBy(*group, "_range").agg(F.sum("n").alias("_rn"))
    ordered = Window.partitionBy(*group).orderBy("_range")
    offsets = by_range.select(
        *group,
        "_range",
        (F.sum("_rn").over(ordered) - F.col("_rn")).alias("_offset"),
        F.sum("_rn").over(Window.partitionBy(*group)).alias("n_total"),
    )
    inside = Window.partitionBy(*group, "_range").orderBy(value)
    return (
        dealt.withColumn("_run", F.sum("n").over(inside) - F.col("n"))
        .join(offsets, [*group, "_range"])
        .select(*group, value, "n", (F.col("_run") + F.col("_offset")).alias("n_below"), "n_total")
    )


def exact_percentiles(
    df: DataFrame, group: list[str], value: str, quantiles: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per quantile."""
    ranked = cumulative_counts(df, group, value, weight)
    upto = F.col("n_below") + F.col("n")
    parts = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("n_total") - 1)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("n_below") <= at) & (at < upto)
            parts.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
    found = ranked.groupBy(*group).agg(F.first("n_total").alias("n_total"), *parts)
    columns = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("n_total") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*group, *columns)


def competition_rank(
    df: DataFrame, group: list[str], value: str, name: str, descending: bool = True
) -> DataFrame:
    """Add the ``rank()`` of ``value`` within its group (ties share a rank).

    Rows join back on (group, value): a value shared by many rows is a hot join
    key on one side only, which AQE splits.  Null values get a null rank.
    """
    ranked = cumulative_counts(df, group, value)
    above = F.col("n_total") - F.col("n_below") - F.col("n")
    rank = (above if descending else F.col("n_below")) + 1
    return df.join(ranked.select(*group, value, rank.alias(name)), [*group, value], "left")
