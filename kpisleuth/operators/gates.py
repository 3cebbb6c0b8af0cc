"""Gates and freshness: should this cell become a case at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import ratio, rounded, steady
from kpisleuth.session import written


def completeness_gate(feeds: DataFrame) -> DataFrame:
    """Share of stores missing from each feed-day against the limit.

    Counting the stores present gives the share without building the
    store x day spine; feed-days with no rows at all are still listed.
    """
    seen = feeds.select("feed", "feed_date", "store_id").distinct()
    present = seen.groupBy("feed", "feed_date").agg(F.count(F.lit(1)).alias("present"))
    estate = seen.agg(
        F.countDistinct("store_id").alias("stores"),
        F.sequence(F.min("feed_date"), F.max("feed_date")).alias("days"),
    )
    spine = (
        present.select("feed").distinct()
        .join(F.broadcast(estate))
        .select("feed", "stores", F.explode("days").alias("feed_date"))
    )
    share = rounded(1.0 - F.coalesce("present", F.lit(0)) / F.col("stores"))
    return spine.join(present, ["feed", "feed_date"], "left").select(
        "feed", "feed_date", "stores",
        F.coalesce("present", F.lit(0)).cast("long").alias("present"),
        share.alias("missing_share"),
        F.when(share > config.MISSING_FEED_SHARE, config.GATES[1]).alias("outcome"),
    )


def incident_impact(feeds: DataFrame) -> DataFrame:
    """Apparent movement if the missing stores of a feed-day are lost: their
    share of usual daily revenue.  Missing revenue is the total less the
    present, so absent pairs are never enumerated; a feed-day without any row,
    a total outage, keeps nothing and shows -100."""
    daily = written(
        feeds.groupBy("feed", "feed_date", "store_id").agg(F.sum("amount").alias("amount")), "feed-days"
    )
    span = daily.agg(
        (F.datediff(F.max("feed_date"), F.min("feed_date")) + 1).alias("n_days"),
        F.sequence(F.min("feed_date"), F.max("feed_date")).alias("days"),
    )
    usual = daily.groupBy("store_id").agg(F.sum("amount").alias("amount")).join(
        F.broadcast(span.select("n_days"))
    ).select("store_id", (F.col("amount") / F.col("n_days")).alias("usual"))
    total = usual.agg(F.sum("usual").alias("total"))
    kept = daily.join(usual, "store_id").groupBy("feed", "feed_date").agg(F.sum("usual").alias("kept"))
    spine = daily.select("feed").distinct().join(F.broadcast(span)).select("feed", F.explode("days").alias("feed_date"))
    share = ratio(F.coalesce("kept", F.lit(0.0)), F.col("total"))
    return spine.join(kept, ["feed", "feed_date"], "left").join(F.broadcast(total)).select(
        "feed", "feed_date", rounded(-100.0 * (1.0 - share)).alias("apparent_movement_pct"),
    )


def with_thresholds(cells: DataFrame, kpis: DataFrame) -> DataFrame:
    """Attach KPI thresholds; ``kpis`` is the literal config table."""
    return cells.join(F.broadcast(kpis), "kpi", "left")


def is_material(delta: Column, delta_pct: Column, spec_unit: Column, limit: Column, floor_pct: Column) -> Column:
    """Movement measured in the threshold's own unit, plus the relative floor.
    Null when the KPI has no limit (monitoring only)."""
    size = F.when(spec_unit == "pct", F.abs(delta_pct)).otherwise(F.abs(delta))
    return F.when(limit.isNotNull(), (size >= limit) & (F.abs(delta_pct) >= floor_pct))


def materiality_gate(cells: DataFrame, kpis: DataFrame) -> DataFrame:
    """Material by size and, where ``band_breach`` tells of a residual band, by leaving it."""
    joined = with_thresholds(cells, kpis)
    if "band_breach" not in cells.columns:
        joined = joined.withColumn("band_breach", F.lit(None).cast("boolean"))
    passed = is_material(
        F.col("delta"), F.col("delta_pct"), F.col("materiality_unit"), F.col("materiality"),
        F.col("min_relative_movement_pct"),
    ) & F.coalesce("band_breach", F.lit(True))
    return joined.withColumn("material", passed).withColumn(
        "outcome",
        F.when(F.col("materiality").isNull(), "MONITORING_ONLY").when(~F.col("material"), config.GATES[2]),
    )


def history_gate(series: DataFrame, keys: list[str], day: str, kpis: DataFrame) -> DataFrame:
    """Distinct weeks held against weeks required."""
    held = series.groupBy(*keys).agg(
        F.countDistinct(F.date_trunc("week", day)).alias("weeks_held")
    )
    need = kpis.select("kpi", "min_history_weeks")
    return held.join(F.broadcast(need), "kpi").withColumn(
        "outcome", F.when(F.col("weeks_held") < F.col("min_history_weeks"), config.GATES[3])
    )


def week_mask(day: str) -> Column:
    """One bit per week of the day's month; ``bit_or`` of it collects weeks."""
    first = F.date_trunc("week", F.date_trunc("month", day))
    offset = (F.datediff(F.date_trunc("week", day), first) / 7).cast("int")
    return F.call_function("shiftleft", F.lit(1), offset)


def weeks_held(months: DataFrame, keys: list[str], period: str, mask: str) -> DataFrame:
    """Distinct weeks per key from monthly week masks, without the facts."""
    bits = months.groupBy(*keys, period).agg(F.bit_or(mask).alias("_bits"))
    week = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(5)), lambda i: F.call_function("shiftright", F.col("_bits"), i) % 2 == 1),
        lambda i: F.date_add(F.date_trunc("week", period).cast("date"), i * 7),
    )
    return bits.select(*keys, F.explode(week).alias("_week")).groupBy(*keys).agg(
        F.countDistinct("_week").alias("weeks_held")
    )


def authorisation_gate(cells: DataFrame, kpi: str, user_region: str) -> DataFrame:
    """Whether each persona of the KPI's policy may see each cell's scope.

    The personas are a literal array inside each row, so nothing is joined.
    """
    personas = F.array(*[
        F.struct(F.lit(name).alias("persona"), F.lit(policy["rows"]).alias("row_scope"))
        for name, policy in config.ACCESS[kpi].items()
    ])
    allowed = (F.col("row_scope") == "all") | (
        (F.col("row_scope") == "own_region") & (F.col("region") == F.lit(user_region))
    )
    return cells.select(*cells.columns, F.inline(personas)).withColumn(
        "outcome", F.when(~allowed, config.GATES[4])
    )


def may_see(kpi: Column, region: Column, persona: str, own_region: str) -> Column:
    """Whether a persona's row scope of the KPI's policy covers a region; a KPI without such a scope is closed to it."""
    scopes = {name: policy[persona]["rows"] for name, policy in config.ACCESS.items() if persona in policy}
    rule = F.element_at(F.create_map(*[F.lit(x) for pair in scopes.items() for x in pair]), kpi)
    return F.coalesce((rule == "all") | ((rule == "own_region") & (region == F.lit(own_region))), F.lit(False))


def persistence_gate(cells: DataFrame, keys: list[str], needed: Column, period_no: Column) -> DataFrame:
    """Breach held for enough consecutive periods (gaps and islands).

    ``period_no`` numbers the periods densely, so a missing period breaks a run.
    """
    island = Window.partitionBy(*keys, "_island").orderBy("_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        cells.withColumn("_no", period_no)
        .withColumn("_island", F.when(F.col("breach"), F.col("_no") - F.row_number().over(
            Window.partitionBy(*keys, "breach").orderBy("_no"))))
        .withColumn("run_length", F.when(F.col("breach"), F.count(F.lit(1)).over(island)).otherwise(0))
        .withColumn("outcome", F.when(F.col("breach") & (F.col("run_length") < needed), config.GATES[5]))
        .drop("_no", "_island")
    )


def can_open(cells: DataFrame, kpis: DataFrame) -> DataFrame:
    """A case may open: limit set, baseline method set, enough history."""
    joined = with_thresholds(cells, kpis)
    return joined.withColumn(
        "can_open",
        F.col("materiality").isNotNull()
        & F.col("baseline_method").isNotNull()
        & (F.col("weeks_held") >= F.col("min_history_weeks")),
    )


def freshness_credit(age_hours: Column, full: Column, zero: Column) -> Column:
    """1 up to ``full`` hours, falling linearly to 0 at ``zero`` hours."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (zero - age_hours) / (zero - full)))


def freshness(sources: DataFrame, keys: list[str], ts: str, as_of: DataFrame, kpi: str) -> DataFrame:
    """Age, credit and staleness of each source at ``as_of`` (one row)."""
    spec = config.KPIS[kpi]
    last = sources.groupBy(*keys).agg(F.max(ts).alias("last_seen"))
    age = (F.unix_micros("as_of") - F.unix_micros("last_seen")) / 3.6e9
    credit = freshness_credit(
        F.col("age_hours"), F.lit(spec["freshness_full_hours"]), F.lit(spec["freshness_zero_hours"])
    )
    return (
        last.join(F.broadcast(as_of))
        .withColumn("age_hours", rounded(age))
        .withColumn("credit", steady(credit))
        .withColumn("stale", F.col("age_hours") > config.TRIGGERS["max_staleness_hours"])
    )


def gate_outcome(cells: DataFrame) -> DataFrame:
    """First failing gate in gate order; null means the cell passes all."""
    checks = [
        (F.col("missing_share") > config.MISSING_FEED_SHARE, 1),
        (~F.coalesce("material", F.lit(False)), 2),
        (F.col("weeks_held") < F.col("min_history_weeks"), 3),
        (~F.col("authorised"), 4),
        (F.col("run_length") < F.col("persistence_periods"), 5),
    ]
    first = F.coalesce(*[F.when(failed, F.lit(no)) for failed, no in checks])
    codes = F.create_map(*[F.lit(x) for pair in config.GATES.items() for x in pair])
    return cells.withColumn("gate_id", first).withColumn("outcome", codes[F.col("gate_id")])
