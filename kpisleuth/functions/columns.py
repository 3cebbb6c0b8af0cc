"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth import config

RATIO_DIGITS = 6


def period_of(day: Column, grain: str) -> Column:
    """Truncate a date to a named grain; unknown grains are refused."""
    if grain not in config.GRAIN_UNIT:
        raise ValueError(f"unsupported grain {grain!r}; use one of {sorted(config.GRAIN_UNIT)}")
    return F.date_trunc(config.GRAIN_UNIT[grain], day).cast("date")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null for a zero denominator."""
    return top / F.nullif(bottom, F.lit(0).cast("double"))


def rounded(col: Column, digits: int = RATIO_DIGITS) -> Column:
    return F.round(col, digits)


def steady(col: Column, digits: int = RATIO_DIGITS) -> Column:
    """Round where exact halves are common (short decimals divided by small
    counts).  The guard settles a half upwards whatever the summation order of
    the binary amounts."""
    return F.round(col + F.lit(1e-9), digits)


def price(col: Column) -> Column:
    """A unit price to four places."""
    return steady(col, 4)


def crore(col: Column) -> Column:
    return F.round(col / F.lit(config.CRORE), RATIO_DIGITS)


def share_true(flag: Column) -> Column:
    """Aggregate: share of rows where the flag holds (null counts as false)."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def count_true(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def previous_by_period(value: Column, keys: list[str], period: str, months: int = 1) -> Column:
    """Value of the same key exactly ``months`` earlier, null across a gap.

    The window holds one row per period of one key, so it stays small however
    many facts lie behind it.
    """
    order = Window.partitionBy(*keys).orderBy(period)
    before = F.lag(F.struct(F.col(period).alias("p"), value.alias("v"))).over(order)
    return F.when(before["p"] == F.add_months(F.col(period), -months), before["v"])


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def spread_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows over all shuffle partitions before a per-series Python step.

    Series are small in bytes but slow in Python; without an explicit count
    AQE would coalesce them into very few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
