"""What-if arithmetic on the store x day panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth.functions.columns import ratio


def loss_multiplier(availability: Column, beta: float | Column, share: float, before: float) -> Column:
    """Demand kept at an availability, relative to demand at the usual one."""
    beta = beta if isinstance(beta, Column) else F.lit(beta)
    kept = lambda level: 1.0 - beta * F.lit(share) * (1.0 - level)
    return kept(availability) / kept(F.lit(before))


def lost_sales(panel: DataFrame, beta: float, share: float, before: float) -> DataFrame:
    """Sales suppressed by the availability gap, row by row."""
    return panel.withColumn(
        "multiplier", loss_multiplier(F.col("availability"), beta, share, before)
    ).withColumn("lost", F.col("revenue") * (1.0 - F.col("multiplier")))


def fit_elasticity(panel: DataFrame, effects: DataFrame, keys: list[str], share: float, before: float) -> DataFrame:
    """Elasticity that yields a measured fractional reduction.

    ``effects`` has the ``reduction`` R of each scope, measured against controls;
    ``panel`` has ``revenue`` and ``availability``.  With the demand-weighted drop
    G, the mechanism obeys R = beta x share x G / (1 - beta x share x (1 - before)),
    hence beta = R / (share x (G + R x (1 - before))).
    """
    drop = F.lit(before) - F.col("availability")
    sums = panel.groupBy(*keys).agg(
        F.sum("revenue").alias("revenue"), F.sum(F.col("revenue") * drop).alias("weighted_drop"),
    ).join(effects, keys)
    g, r = ratio(F.col("weighted_drop"), F.col("revenue")), F.col("reduction")
    return sums.select(
        *keys, "reduction", g.alias("demand_weighted_drop"),
        ratio(r, F.lit(share) * (g + r * (1.0 - before))).alias("beta"),
    )


def neutrality(panel: DataFrame, keys: list[str], beta: float, share: float, before: float) -> DataFrame:
    """Largest change of rows that must not move: availability set to its usual
    level everywhere, and untreated or pre-onset rows left alone."""
    neutral = loss_multiplier(F.lit(before), beta, share, before)
    actual = loss_multiplier(
        F.when(F.col("is_treated") & F.col("after_onset"), F.col("availability")).otherwise(F.lit(before)),
        beta, share, before,
    )
    exempt = ~(F.col("is_treated") & F.col("after_onset"))
    change = lambda m: F.abs(F.col("revenue") * m - F.col("revenue"))
    return panel.groupBy(*keys).agg(
        F.max(change(neutral)).alias("max_neutral_change"),
        F.max(F.when(exempt, change(actual))).alias("max_exempt_change"),
        F.max(F.when(~exempt, change(actual))).alias("max_treated_change"),
    )


def adjust(panel: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Multiply by (1 + shift) where a shift is given; elsewhere unchanged."""
    return panel.join(shifts, keys, "left").withColumn(
        "adjusted", F.col("amount") * (1.0 + F.coalesce("shift", F.lit(0.0)))
    )
