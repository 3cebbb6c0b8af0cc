"""Conforming raw facts: scope, netting, restatement, calendar, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import crore, period_of, ratio, rounded, spread_by, steady


def in_scope(sales: DataFrame, kpi: str = "net_revenue") -> DataFrame:
    """Drop transfers, and wholesale where the KPI's contract excludes it."""
    kept = sales.where(F.col("txn_type") != config.EXCLUDED_TXN_TYPE)
    if config.KPIS[kpi]["excludes_b2b"]:
        kept = kept.where(F.col("channel") != config.EXCLUDED_CHANNEL)
    return kept


def net_amount() -> Column:
    return (
        F.col("gross_amount") - F.col("returns_amount") - F.col("discount_amount") - F.col("tax_amount")
    )


def with_net(sales: DataFrame) -> DataFrame:
    return sales.withColumn("net_amount", net_amount())


def store_code_changes(sales: DataFrame) -> DataFrame:
    """Stores seen under more than one code, with each code's first day.

    Reduces to (store, code) first, so a busy store never meets one task.
    """
    per_code = sales.groupBy("store_id", "store_code").agg(F.min("txn_date").alias("first_seen"))
    return (
        per_code.groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("codes"),
            F.max_by("store_code", "first_seen").alias("latest_code"),
            F.max("first_seen").alias("changed_on"),
        )
        .where(F.col("codes") > 1)
    )


def net_by_processed_period(sales: DataFrame, grain: str, keys: list[str]) -> DataFrame:
    """Gross, discount and tax on the sale date; returns on the posted date.

    Each sale line yields at most two dated amounts in one pass over the facts.
    """
    kept = F.col("gross_amount") - F.col("discount_amount") - F.col("tax_amount")
    entry = lambda day, sold, returned: F.struct(
        F.col(day).alias("day"), sold.alias("sold"), returned.alias("returned")
    )
    zero = F.lit(0.0)
    entries = F.array(
        entry("txn_date", kept, zero),
        entry("posted_date", zero, F.col("returns_amount")),
    )
    return (
        sales.select(*keys, F.explode(entries).alias("e"))
        .where((F.col("e.sold") != 0) | (F.col("e.returned") != 0))
        .groupBy(*keys, period_of(F.col("e.day"), grain).alias("period"))
        .agg(
            crore(F.sum("e.sold")).alias("sold_cr"),
            crore(F.sum("e.returned")).alias("returned_cr"),
            crore(F.sum(F.col("e.sold") - F.col("e.returned"))).alias("net_cr"),
        )
    )


def restatement_audit(sales: DataFrame) -> DataFrame:
    """Returned lines by posting lag: count, amount and share of all returns."""
    by_lag = (
        sales.where(F.col("returns_amount") > 0)
        .groupBy(F.datediff("posted_date", "txn_date").alias("lag_days"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("returns_amount").alias("amount"))
    )
    total = by_lag.agg(F.sum("lines").alias("all_lines"), F.sum("amount").alias("all_amount"))
    return by_lag.join(F.broadcast(total)).select(
        "lag_days",
        "lines",
        crore(F.col("amount")).alias("amount_cr"),
        rounded(F.col("lines") / F.col("all_lines")).alias("line_share"),
        rounded(
            F.when(F.col("lag_days") > 0, F.col("amount")).otherwise(0.0) / F.col("all_amount")
        ).alias("missed_same_day_share"),
    )


def hash_fraction(key: Column) -> Column:
    """Deterministic number in [0, 1) from the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def hash_sample(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Keep the keys whose hash falls under the rate, and record the rate."""
    return df.where(hash_fraction(F.col(key)) < rate).withColumn("sample_rate", F.lit(rate))


def reweight(df: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Estimate totals from a sampled table by weighting with 1/sample_rate."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sampled_lines"),
        steady(F.sum(amount / F.col("sample_rate")) / config.CRORE).alias("estimate_cr"),
    )


def calendar_columns(days: DataFrame, day: str = "date") -> DataFrame:
    """Calendar attributes of a date column."""
    d = F.col(day)
    fiscal = F.year(d) - F.when(F.month(d) < config.FISCAL_START_MONTH, 1).otherwise(0)
    two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
    return days.select(
        *days.columns,
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.weekday(d).alias("dow"),
        F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"),
        F.weekofyear(d).alias("iso_week"),
        F.date_format(d, "yyyy-MM").alias("period_month"),
        fiscal.alias("fiscal_year"),
        F.concat(F.lit("FY"), two(fiscal), F.lit("-"), two(fiscal + 1)).alias("fiscal_year_label"),
        (F.floor(((F.month(d) - config.FISCAL_START_MONTH + 12) % 12) / 3) + 1).cast("int").alias("fiscal_quarter"),
        (F.weekday(d) >= 5).alias("is_weekend"),
        (d == F.last_day(d)).alias("is_month_end"),
        F.dayofmonth(d).isin(config.PAYDAYS).alias("is_payday"),
    )


def days_from(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per day between two dates held in ``bounds``."""
    return bounds.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("date"))


def festival_days(windows: DataFrame) -> DataFrame:
    """Bridge table of day and festival; overlapping festivals keep all rows."""
    return windows.select(
        F.explode(F.sequence("window_start", "window_end")).alias("date"), "festival"
    )


def calendar(days: DataFrame, windows: DataFrame) -> DataFrame:
    """Calendar dimension with the festivals of each day (sorted, joined)."""
    names = festival_days(windows).groupBy("date").agg(
        F.array_join(F.sort_array(F.collect_set("festival")), "|").alias("festivals")
    )
    return (
        calendar_columns(days)
        .join(F.broadcast(names), "date", "left")
        .withColumn("festivals", F.coalesce("festivals", F.lit("")))
        .withColumn("is_festival", F.col("festivals") != "")
    )


def densify(facts: DataFrame, members: DataFrame, bounds: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Every member on every day between the bounds; days without facts are null.

    ``bounds`` has one row (first_day, last_day).  The spine is generated by
    exploding the day range inside each member row, not by a product join.  The
    members, a small table in few partitions, are spread before they are exploded.
    """
    spine = spread_by(members, keys).join(F.broadcast(bounds)).select(
        *keys, F.explode(F.sequence("first_day", "last_day")).alias(day)
    )
    return spine.join(facts, [*keys, day], "left")


def reconcile(detail: DataFrame, total: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Detail summed to the total's keys; rows whose gap exceeds the tolerance
    and rows present on one side only."""
    summed = detail.groupBy(*keys).agg(F.sum("amount").alias("detail_amount"))
    return (
        summed.join(total.withColumnRenamed("amount", "total_amount"), keys, "full_outer")
        .withColumn("gap", F.coalesce("detail_amount", F.lit(0.0)) - F.coalesce("total_amount", F.lit(0.0)))
        .where(
            F.col("detail_amount").isNull() | F.col("total_amount").isNull() | (F.abs("gap") > tolerance)
        )
    )


def allocation_weight(share: Column, availability: Column, best: Column) -> Column:
    """Share damped by availability relative to the best day."""
    relative = F.coalesce(ratio(availability, best), F.lit(1.0))
    return share * (F.lit(config.ALLOCATION_FLOOR) + F.lit(config.ALLOCATION_SLOPE) * relative)


def allocate(total: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Split each total over its children in proportion to their weights.

    The weight sum is a separate aggregate joined back, so a group with very
    many children is combined map-side instead of sorted in one task.
    """
    sums = weights.groupBy(*keys).agg(F.sum("weight").alias("weight_sum"))
    scale = total.join(sums, keys).withColumn(
        "per_weight", ratio(F.col("amount"), F.col("weight_sum"))
    ).select(*keys, "per_weight")
    return weights.join(scale, keys).withColumn("allocated", F.col("weight") * F.col("per_weight")).drop("per_weight")


def to_control_total(df: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Scale each group's series so that it sums to the group's target."""
    factors = (
        df.groupBy(*keys).agg(F.sum("amount").alias("_sum"))
        .join(targets, keys)
        .select(*keys, ratio(F.col("target"), F.col("_sum")).alias("factor"))
    )
    return df.join(factors, keys).withColumn("benchmarked", F.col("amount") * F.col("factor"))


def week_buckets(cal: DataFrame) -> DataFrame:
    return cal.groupBy("iso_year", "iso_week").agg(
        F.min("date").alias("week_start"), F.count(F.lit(1)).alias("days")
    )


def quarter_buckets(cal: DataFrame) -> DataFrame:
    return cal.groupBy("fiscal_year", "fiscal_quarter").agg(
        F.min("date").alias("quarter_start"), F.count(F.lit(1)).alias("days")
    )


def day_bounds(df: DataFrame, day: str) -> DataFrame:
    """First and last day of a fact table: one row."""
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


