"""Queries over movement, gates and evidence (D, G and E operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import count_true, crore, price, ratio, rounded, steady
from kpisleuth.functions.stats import p_chi2_1
from kpisleuth.operators import baseline, conform, evidence, gates, movement
from kpisleuth.plans.facts import (
    FESTIVAL_SPANS, FESTIVAL_WINDOW_ROWS, INTENSITY_ROWS, REGION_OF, conformed, customer_regions, festival_windows,
    region_cells, sales_days,
)
from kpisleuth.plans.registry import VIEWS, query
from kpisleuth.session import written
from kpisleuth.sources import standins, tables

REGION = ["region"]
# Patterns that the given notes contain, next to the configured ones.
NOTE_PATTERN = config.UNAVAILABLE_PATTERN + "|license|copyright|error"
TICKET_PATTERN = config.TICKET_PATTERN + "|license|copyright"
CUT_DATE = "1998-06-01"
FESTIVAL_AMPLITUDE = 0.55


def r(col: str, digits: int = 6):
    return F.round(col, digits).alias(col)


# --- D: movement, baseline, residual ----------------------------------------
VIEWS |= baseline.expected_sql("net", "cells_v", "(SELECT * FROM scope_v JOIN stores_v USING (store_id))", "txn_date", "net", "region", FESTIVAL_SPANS)
VIEWS["bill_seen_v"] = "SELECT DISTINCT region, txn_id, txn_date FROM scope_v JOIN stores_v USING (store_id)"
VIEWS["bill_cell_v"] = """
SELECT region, CAST(date_trunc('month', txn_date) AS DATE) AS period, CAST(count(DISTINCT txn_id) AS DOUBLE) AS value FROM bill_seen_v GROUP BY 1, 2
"""
VIEWS |= baseline.expected_sql("bill", "bill_cell_v", "bill_seen_v", "txn_date", "1.0", "region", FESTIVAL_SPANS, 1.0)


def expected_cells(spark, folder) -> DataFrame:
    """Region-months with the contract's expected value, from one aggregate of the facts."""
    per_store = conformed(spark, folder).groupBy("store_id", F.date_trunc("month", "txn_date").cast("date").alias("period")).agg(
        F.sum("net_amount").alias("net"), *baseline.moment_sums(F.col("net_amount"), F.col("txn_date"), FESTIVAL_SPANS))
    sums = per_store.join(standins.stores(spark, folder).select("store_id", "region"), "store_id").groupBy("region", "period").agg(
        F.sum("net").alias("net"), *baseline.moment_totals(FESTIVAL_SPANS))
    cells = written(baseline.with_moments(sums, ["region", "period"], "net", FESTIVAL_SPANS), "region-moments")
    return baseline.calendar_expected(cells, REGION, "region string", FESTIVAL_SPANS)


def decomposed_cells(spark, folder) -> DataFrame:
    return movement.decompose(expected_cells(spark, folder), REGION)


@query("d1_movement", """
SELECT region, period, value, previous, round(value - previous, 6) AS delta, round(headline_pt, 6) AS delta_pct FROM decomposed_v
""")
def d1(spark, folder):
    return movement.movement(region_cells(spark, folder), REGION).select(
        "region", "period", "value", "previous", r("delta"), r("delta_pct")
    )


@query("d2_decompose", """
SELECT region, period, round(expected, 6) AS expected, round(headline_pt, 6) AS headline_pt,
  round(calendar_pt, 6) AS calendar_pt, round(residual_pt, 6) AS residual_pt,
  round(calendar_pt / 100.0 * previous, 6) AS calendar_value, round(residual_pt / 100.0 * previous, 6) AS residual_value
FROM decomposed_v WHERE expected IS NOT NULL
""")
def d2(spark, folder):
    return decomposed_cells(spark, folder).where("expected IS NOT NULL").select(
        "region", "period", r("expected"), r("headline_pt"), r("calendar_pt"), r("residual_pt"),
        r("calendar_value"), r("residual_value"),
    )


@query("d3_residual_strip", """
SELECT region, period, round(100.0 * (value - expected) / nullif(previous, 0), 6) AS strip_pt FROM decomposed_v
WHERE expected IS NOT NULL
""")
def d3(spark, folder):
    return movement.residual_strip(expected_cells(spark, folder), REGION).where("expected IS NOT NULL").select(
        "region", "period", r("strip_pt")
    )


@query("d4_growth_residual", """
SELECT region, period, round(100.0 * (value / nullif(previous, 0) - 1.0), 6) AS actual_growth_pt,
  round(100.0 * (expected / nullif(expected_previous, 0) - 1.0), 6) AS expected_growth_pt,
  round(100.0 * (value / nullif(previous, 0) - 1.0) - 100.0 * (expected / nullif(expected_previous, 0) - 1.0), 6) AS growth_residual_pt
FROM decomposed_v WHERE expected_previous IS NOT NULL
""")
def d4(spark, folder):
    return movement.growth_residual(expected_cells(spark, folder), REGION).where(
        "expected_growth_pt IS NOT NULL"
    ).select("region", "period", r("actual_growth_pt"), r("expected_growth_pt"), r("growth_residual_pt"))


def daily_region(spark, folder) -> DataFrame:
    """Dense region x day revenue in crore; days without sales are null."""
    facts = conformed(spark, folder)
    per_store = facts.groupBy("store_id", "txn_date").agg(F.sum("net_amount").alias("net"))
    stores = standins.stores(spark, folder).select("store_id", "region")
    daily = written(per_store.join(stores, "store_id").groupBy("region", F.col("txn_date").alias("date")).agg(
        crore(F.sum("net")).alias("value")
    ), "region-days")
    return conform.densify(daily, stores.select("region").distinct(), conform.day_bounds(daily, "date"), REGION, "date")


def baseline_days(spark, folder) -> DataFrame:
    return movement.seasonal_baseline(daily_region(spark, folder), REGION)


@query("d5_seasonal_baseline", """
SELECT region, date, round(value, 6) AS value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
  round(residual, 6) AS residual FROM baseline_v
""")
def d5(spark, folder):
    return baseline_days(spark, folder).select("region", "date", r("value"), r("trend"), r("seasonal"), r("residual"))


@query("d5_loess_baseline")
def d5_loess(spark, folder):
    return movement.loess_baseline(daily_region(spark, folder), REGION, "region string").select(
        "region", "date", r("value"), r("trend"), r("seasonal"), r("residual")
    )


@query("d6_flag_regression", """
SELECT region, round(regr_slope(value, CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS effect,
  round(regr_intercept(value, CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS level,
  round(regr_r2(value, CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END), 6) AS r2 FROM daily_v GROUP BY 1
""")
def d6(spark, folder):
    flagged = daily_region(spark, folder).withColumn("is_weekend", F.weekday("date") >= 5)
    return movement.flag_regression(flagged, REGION, "is_weekend").select("region", r("effect"), r("level"), r("r2"))


@query("d6_calendar_regression")
def d6_many(spark, folder):
    calendar = conform.calendar(sales_days(spark, folder), config.festival_window_table(spark, festival_windows()))
    flagged = daily_region(spark, folder).join(
        calendar.select("date", "is_weekend", "is_month_end", "is_payday", "is_festival"), "date"
    )
    flags = ["is_weekend", "is_month_end", "is_payday", "is_festival"]
    fitted = movement.calendar_regression(flagged, REGION, "region string", flags)
    return fitted.select("region", *[r(c) for c in fitted.columns if c != "region"])


@query("d7_festival_factor", f"""
SELECT s.region, s.date, round(coalesce(e.factor, 1.0) + 1e-9, 6) AS factor FROM (
  SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT region FROM (VALUES {INTENSITY_ROWS}) AS t(festival, region, intensity)),
    (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)
) s LEFT JOIN (
  SELECT region, date, exp(sum(ln(CASE WHEN after <= 0 THEN 1.0 + {FESTIVAL_AMPLITUDE} * intensity * sin(pi() *
      CASE WHEN pos <= peak THEN 0.5 * pos / peak ELSE 0.5 + 0.5 * (pos - peak) / (1.0 - peak) END)
    ELSE 1.0 - 0.34 * {FESTIVAL_AMPLITUDE} * intensity * (8 - after) / 8.0 END))) AS factor
  FROM (
    SELECT festival, date, peak, CAST(date - window_end AS INTEGER) AS after,
      (CAST(date - window_start AS INTEGER) + 1) / CAST(CAST(window_end - window_start AS INTEGER) + 2 AS DOUBLE) AS pos
    FROM (SELECT *, CAST(unnest(generate_series(window_start, window_end + 7, INTERVAL 1 DAY)) AS DATE) AS date
          FROM (VALUES {FESTIVAL_WINDOW_ROWS}) AS t(festival, window_start, window_end, peak))
  ) JOIN (VALUES {INTENSITY_ROWS}) AS i(festival, region, intensity) USING (festival)
  WHERE intensity > 0 GROUP BY 1, 2
) e ON e.region = s.region AND e.date = s.date
""")
def d7(spark, folder):
    return movement.festival_factor(
        sales_days(spark, folder), config.festival_window_table(spark, festival_windows()),
        config.festival_intensity_table(spark, REGION_OF), FESTIVAL_AMPLITUDE,
    ).select("region", "date", steady(F.col("factor")).alias("factor"))


_WEEK_RESIDUAL_SQL = """
(SELECT region, CAST(date_trunc('week', date) AS DATE) AS period, sum(residual) AS residual
 FROM baseline_v WHERE residual IS NOT NULL GROUP BY 1, 2)
"""


def band_weeks(spark, folder) -> DataFrame:
    weekly = movement.weekly(baseline_days(spark, folder).where("residual IS NOT NULL"), REGION, "residual")
    return movement.residual_band(weekly, REGION, "net_revenue")


@query("d8_residual_band", f"""
SELECT region, period, round(residual, 6) AS residual,
  round(quantile_cont(abs(residual), 0.9) OVER w, 6) AS band, count(residual) OVER w AS weeks_held
FROM {_WEEK_RESIDUAL_SQL}
WINDOW w AS (PARTITION BY region ORDER BY CAST(period - DATE '1970-01-05' AS INTEGER) // 7 RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)
""")
def d8(spark, folder):
    return band_weeks(spark, folder).select("region", "period", r("residual"), r("band"), "weeks_held")


VIEWS["price_mix_v"] = """
SELECT c.region, c.period, asp, asp_before, asp - asp_before AS asp_delta, price_effect FROM (
  SELECT n.region, n.period, sum(n.net) / sum(n.units) AS asp,
    sum(coalesce((n.net / n.units - p.net / p.units) * p.units / p.total, 0.0)) AS price_effect
  FROM parts_v n LEFT JOIN parts_v p ON p.region = n.region AND p.sub_category = n.sub_category
    AND p.period = CAST(n.period - INTERVAL 1 MONTH AS DATE)
  GROUP BY 1, 2
) c JOIN (
  SELECT region, period, sum(net) / sum(units) AS asp_before FROM parts_v GROUP BY 1, 2
) b ON b.region = c.region AND b.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
"""


@query("d9_price_mix", """
SELECT region, period, round(asp + 1e-9, 4) AS asp, round(asp_delta + 1e-9, 4) AS asp_delta,
  round(price_effect + 1e-9, 4) AS price_effect, round(asp_delta - price_effect + 1e-9, 4) AS mix_effect FROM price_mix_v
""")
def d9(spark, folder):
    return region_price_mix(spark, folder).select(
        "region", "period", *[price(F.col(c)).alias(c) for c in ("asp", "asp_delta", "price_effect", "mix_effect")]
    )


def region_price_mix(spark, folder) -> DataFrame:
    """Price and mix parts of each region's monthly change in selling price."""
    month = F.date_trunc("month", "txn_date").cast("date").alias("period")
    per_sku = conformed(spark, folder).groupBy("store_id", "sku_id", month).agg(
        F.sum("net_amount").alias("net"), F.sum("units").alias("units")
    )
    parts = (
        per_sku.join(standins.stores(spark, folder).select("store_id", "region"), "store_id")
        .join(standins.skus(spark, folder).select("sku_id", "sub_category"), "sku_id")
        .groupBy("region", "sub_category", "period")
        .agg(F.sum("net").alias("net"), F.sum("units").alias("units"))
    )
    return movement.price_mix(parts, REGION, "sub_category")


def store_movement(spark, folder) -> DataFrame:
    """Store-month revenue against the month before."""
    cells = conformed(spark, folder).groupBy(
        "store_id", F.date_trunc("month", "txn_date").cast("date").alias("period")
    ).agg(crore(F.sum("net_amount")).alias("value"))
    return movement.movement(cells, ["store_id"])


@query("d10_rank_cells", """
SELECT store_id, period, delta, CASE WHEN delta IS NOT NULL
  THEN rank() OVER (PARTITION BY period ORDER BY delta NULLS LAST) END AS rank
FROM (
  SELECT c.store_id, c.period, round(c.value - p.value, 6) AS delta FROM store_month_v c
  LEFT JOIN store_month_v p ON p.store_id = c.store_id AND p.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
)
""")
def d10(spark, folder):
    moved = written(store_movement(spark, folder).select("store_id", "period", r("delta")), "store-movement")
    return movement.rank_cells(moved, ["period"], "delta").select("store_id", "period", "delta", "rank")


# --- G: gates ----------------------------------------------------------------
@query("g1_completeness", """
SELECT feed, feed_date, stores, coalesce(present, 0) AS present,
  round(1.0 - coalesce(present, 0) / stores, 6) AS missing_share,
  CASE WHEN round(1.0 - coalesce(present, 0) / stores, 6) > 0.05 THEN 'DATA_INCIDENT' END AS outcome
FROM (
  SELECT feed, stores, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS feed_date
  FROM (SELECT DISTINCT feed FROM feeds_v),
    (SELECT count(DISTINCT store_id) AS stores, min(feed_date) AS lo, max(feed_date) AS hi FROM feeds_v)
) s LEFT JOIN (
  SELECT feed, feed_date, count(DISTINCT store_id) AS present FROM feeds_v GROUP BY 1, 2
) p USING (feed, feed_date)
""")
def g1(spark, folder):
    return gates.completeness_gate(standins.feed_events(spark, folder))


_USUAL_SQL = """
(SELECT store_id, sum(amount) / (SELECT max(feed_date) - min(feed_date) + 1 FROM feeds_v) AS usual FROM feeds_v GROUP BY 1)
"""


@query("g2_incident_impact", f"""
SELECT feed, feed_date, round(-100.0 * (1.0 - coalesce(kept, 0.0) / (SELECT sum(usual) FROM {_USUAL_SQL})), 6) AS apparent_movement_pct
FROM (
  SELECT feed, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS feed_date
  FROM (SELECT DISTINCT feed FROM feeds_v), (SELECT min(feed_date) AS lo, max(feed_date) AS hi FROM feeds_v)
) LEFT JOIN (
  SELECT feed, feed_date, sum(usual) AS kept FROM (SELECT DISTINCT feed, feed_date, store_id FROM feeds_v) JOIN {_USUAL_SQL} USING (store_id)
  GROUP BY 1, 2
) USING (feed, feed_date)
""")
def g2(spark, folder):
    return gates.incident_impact(standins.feed_events(spark, folder))


KPI_CELLS_SQL = """
(SELECT 'net_revenue' AS kpi, region, period, value FROM cells_v
 UNION ALL
 SELECT 'transactions', region, CAST(date_trunc('month', txn_date) AS DATE), CAST(count(DISTINCT txn_id) AS DOUBLE)
 FROM scope_v JOIN stores_v USING (store_id) GROUP BY 2, 3
 UNION ALL
 SELECT 'avg_selling_price', region, CAST(date_trunc('month', txn_date) AS DATE), round(sum(net) / sum(units) + 1e-9, 4)
 FROM scope_v JOIN stores_v USING (store_id) GROUP BY 2, 3
 UNION ALL
 SELECT 'qcomm_fulfilment_rate', region, CAST(date_trunc('month', order_date) AS DATE),
   round(100.0 * count(*) FILTER (WHERE lines_shipped = lines_ordered AND delivered_date <= promised_date) / count(*), 6)
 FROM qcomm_v JOIN stores_v ON store_id = dark_store_id WHERE txn_type <> 'TRANSFER' GROUP BY 2, 3)
"""


def month(day: str):
    return F.date_trunc("month", day).cast("date").alias("period")


def store_months(spark, folder) -> DataFrame:
    """Additive parts per store and month."""
    return conformed(spark, folder).groupBy("store_id", month("txn_date")).agg(
        F.sum("net_amount").alias("net"), F.sum("units").alias("units"), F.bit_or(gates.week_mask("txn_date")).alias("weeks"),
        *baseline.moment_sums(F.col("net_amount"), F.col("txn_date"), FESTIVAL_SPANS),
    )


def region_bills(spark, folder) -> DataFrame:
    """Bills of a region, with their moments: one that several of its stores share counts once."""
    stores = standins.stores(spark, folder).select("store_id", "region")
    bill = ["txn_id", "txn_date"]
    seen = conformed(spark, folder).select("store_id", *bill).distinct()
    return seen.join(stores, "store_id").select("region", *bill).distinct().groupBy("region", month("txn_date")).agg(
        F.count(F.lit(1)).alias("bills"), *baseline.moment_sums(F.lit(1.0), F.col("txn_date"), FESTIVAL_SPANS))


def kpi_cells(spark, folder, per_store: DataFrame | None = None, bills: DataFrame | None = None) -> DataFrame:
    """Four KPIs by region and month in long form."""
    stores = standins.stores(spark, folder).select("store_id", "region")
    if per_store is None:
        per_store = store_months(spark, folder)
    if bills is None:
        bills = region_bills(spark, folder)
    sums = per_store.join(stores, "store_id").groupBy("region", "period").agg(
        F.sum("net").alias("net"), F.sum("units").alias("units")
    ).join(bills.select("region", "period", "bills"), ["region", "period"])
    long = sums.select("region", "period", F.inline(F.array(
        F.struct(F.lit("net_revenue").alias("kpi"), crore(F.col("net")).alias("value")),
        F.struct(F.lit("transactions").alias("kpi"), F.col("bills").cast("double").alias("value")),
        F.struct(F.lit("avg_selling_price").alias("kpi"), price(ratio(F.col("net"), F.col("units"))).alias("value")),
    ))).select("kpi", "region", "period", "value")
    orders = standins.qcomm_orders(spark, folder).where(F.col("txn_type") != config.EXCLUDED_TXN_TYPE)
    good = (F.col("lines_shipped") == F.col("lines_ordered")) & (F.col("delivered_date") <= F.col("promised_date"))
    quick = (
        orders.groupBy(F.col("dark_store_id").alias("store_id"), month("order_date"))
        .agg(count_true(good).alias("good"), F.count(F.lit(1)).alias("n"))
        .join(stores, "store_id").groupBy("region", "period")
        .agg(rounded(100.0 * F.sum("good") / F.sum("n")).alias("value"))
        .select(F.lit("qcomm_fulfilment_rate").alias("kpi"), "region", "period", "value")
    )
    return long.unionByName(quick)


# KPIs that add up over days; the others are rates or prices.
ADDITIVE = ("net_revenue", "transactions")
_KPI_EXPECTED_SQL = f"""
(SELECT t.* EXCLUDE (expected), CASE kpi WHEN 'net_revenue' THEN n.expected WHEN 'transactions' THEN b.expected ELSE t.expected END AS expected FROM (
  SELECT *, CASE WHEN count(value) OVER w = 12 THEN avg(value) OVER w END AS expected FROM {KPI_CELLS_SQL}
  WINDOW w AS (PARTITION BY kpi, region ORDER BY period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) t
 LEFT JOIN net_expected_v n ON n.region = t.region AND n.period = t.period LEFT JOIN bill_expected_v b ON b.region = t.region AND b.period = t.period)
"""
_BREACH_SQL = f"""
(SELECT 'net_revenue' AS kpi, region, CAST(date_trunc('month', period) AS DATE) AS period, bool_or(abs(residual) > band) AS band_breach
 FROM (SELECT *, quantile_cont(abs(residual), 0.9) OVER w AS band FROM {_WEEK_RESIDUAL_SQL}
  WINDOW w AS (PARTITION BY region ORDER BY CAST(period - DATE '1970-01-05' AS INTEGER) // 7 RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) GROUP BY 2, 3)
"""
_MATERIAL_SQL = f"""
(SELECT m.*, k.materiality, k.materiality_unit, k.persistence_periods, k.min_history_weeks, k.baseline_method,
  CASE WHEN k.materiality IS NOT NULL THEN
    CASE WHEN materiality_unit = 'pct' THEN abs(residual_pt) ELSE abs(residual_value) END >= materiality
    AND abs(residual_pt) >= min_relative_movement_pct END AND coalesce(band_breach, true) AS material
 FROM (
  SELECT *, residual_pt / 100.0 * previous AS residual_value FROM (
    SELECT c.*, p.value AS previous,
      100.0 * (c.value - p.value) / nullif(p.value, 0) - 100.0 * (c.expected / nullif(p.value, 0) - 1.0) AS residual_pt
    FROM {_KPI_EXPECTED_SQL} c LEFT JOIN {KPI_CELLS_SQL} p ON p.kpi = c.kpi AND p.region = c.region
      AND p.period = CAST(c.period - INTERVAL 1 MONTH AS DATE))
 ) m JOIN kpi_v k ON k.kpi = m.kpi LEFT JOIN {_BREACH_SQL} x ON x.kpi = m.kpi AND x.region = m.region AND x.period = m.period)
"""


def expected_kpi_cells(spark, folder, per_store: DataFrame, bills: DataFrame | None, cells: DataFrame | None) -> DataFrame:
    """Cells with the expected value: the contract's baseline for what adds up over days, the trailing mean for rates and prices.
    Without ``cells`` there is net revenue alone."""
    keys = ["kpi", "region"]
    stores = standins.stores(spark, folder).select("store_id", "region")
    sums = per_store.join(stores, "store_id").groupBy("region", "period").agg(F.sum("net").alias("net"), *baseline.moment_totals(FESTIVAL_SPANS))
    named = lambda kpi: [F.lit(kpi).alias("kpi"), "region", "period"]
    held = baseline.with_moments(sums, named("net_revenue"), "net", FESTIVAL_SPANS)
    if bills is not None:
        held = held.unionByName(baseline.with_moments(bills, named("transactions"), "bills", FESTIVAL_SPANS, 1.0))
    whole = baseline.calendar_expected(written(held, "kpi-moments"), keys, "kpi string, region string", FESTIVAL_SPANS)
    if cells is None:
        return whole
    fitted = whole.select(*keys, "period", F.col("expected").alias("_fitted"))
    trailing = movement.trailing_expected(cells, keys, additive=F.lit(False))
    return trailing.join(fitted, [*keys, "period"], "left").withColumn(
        "expected", F.when(F.col("kpi").isin(*ADDITIVE), F.col("_fitted")).otherwise(F.col("expected"))).drop("_fitted")


def breached_months(spark, folder) -> DataFrame:
    """Months with a week outside the trailing residual band."""
    return band_weeks(spark, folder).groupBy(F.lit("net_revenue").alias("kpi"), "region", month("period")).agg(F.bool_or("breach").alias("band_breach"))


def material_cells(spark, folder, per_store: DataFrame | None = None, revenue_only: bool = False) -> DataFrame:
    """Cells whose residual, not their raw movement, is held against the limit and the band."""
    if per_store is None:
        per_store = written(store_months(spark, folder), "store-months")
    bills = None if revenue_only else written(region_bills(spark, folder), "region-bills")
    cells = None if revenue_only else written(kpi_cells(spark, folder, per_store, bills), "kpi-cells")
    split = movement.decompose(expected_kpi_cells(spark, folder, per_store, bills, cells), ["kpi", "region"])
    banded = split.join(breached_months(spark, folder), ["kpi", "region", "period"], "left")
    return gates.materiality_gate(
        banded.drop("delta", "delta_pct").withColumns({"delta": F.col("residual_value"), "delta_pct": F.col("residual_pt")}),
        config.kpi_table(spark))


@query("g3_materiality", f"""
SELECT kpi, region, period, round(residual_value, 3) AS residual_value, round(residual_pt, 3) AS residual_pt, material,
  CASE WHEN materiality IS NULL THEN 'MONITORING_ONLY' WHEN NOT material THEN 'IMMATERIAL' END AS outcome
FROM {_MATERIAL_SQL}
""")
def g3(spark, folder):
    return material_cells(spark, folder).select(
        "kpi", "region", "period", r("residual_value", 3), r("residual_pt", 3), "material", "outcome"
    )


_HISTORY_SQL = """
(SELECT h.*, min_history_weeks FROM (
  SELECT kpi, region, count(DISTINCT date_trunc('week', txn_date)) AS weeks_held
  FROM scope_v JOIN stores_v USING (store_id), (VALUES ('net_revenue'), ('transactions'), ('avg_selling_price')) AS s(kpi) GROUP BY 1, 2
  UNION ALL
  SELECT 'qcomm_fulfilment_rate', region, count(DISTINCT date_trunc('week', order_date)) FROM qcomm_v JOIN stores_v ON store_id = dark_store_id
  WHERE txn_type <> 'TRANSFER' GROUP BY 1, 2
  UNION ALL
  SELECT 'on_shelf_availability', region, count(DISTINCT date_trunc('week', snapshot_date)) FROM inv_v JOIN stores_v USING (store_id) GROUP BY 1, 2
  UNION ALL
  SELECT 'conversion_rate', 'R' || (store_id % 5), count(DISTINCT date_trunc('week', feed_date)) FROM feeds_v GROUP BY 1, 2
) h JOIN kpi_v k ON k.kpi = h.kpi)
"""


def history(spark, folder) -> DataFrame:
    """Weeks with data per KPI and region; every feed is reduced to its store-weeks before the stores attach."""
    def weeks(facts: DataFrame, store: str, day: str) -> DataFrame:
        return facts.select(F.col(store).alias("store_id"), F.date_trunc("week", day).cast("date").alias("day")).distinct()

    def placed(kpis: list[str], held: DataFrame) -> DataFrame:
        stores = standins.stores(spark, folder).select("store_id", "region")
        return held.join(stores, "store_id").select(F.explode(F.array(*map(F.lit, kpis))).alias("kpi"), "region", "day")

    orders = standins.qcomm_orders(spark, folder).where(F.col("txn_type") != config.EXCLUDED_TXN_TYPE)
    seen = weeks(standins.feed_events(spark, folder), "store_id", "feed_date").select(
        F.lit("conversion_rate").alias("kpi"), F.concat(F.lit("R"), (F.col("store_id") % 5).cast("string")).alias("region"), "day")
    every = (
        placed(["net_revenue", "transactions", "avg_selling_price"], weeks(conformed(spark, folder), "store_id", "txn_date"))
        .unionByName(placed(["qcomm_fulfilment_rate"], weeks(orders, "dark_store_id", "order_date")))
        .unionByName(placed(["on_shelf_availability"], weeks(standins.inventory(spark, folder), "store_id", "snapshot_date")))
        .unionByName(seen)
    )
    return gates.history_gate(every, ["kpi", "region"], "day", config.kpi_table(spark))


@query("g4_history", f"""
SELECT kpi, region, weeks_held, min_history_weeks,
  CASE WHEN weeks_held < min_history_weeks THEN 'INSUFFICIENT_HISTORY' END AS outcome FROM {_HISTORY_SQL}
""")
def g4(spark, folder):
    return history(spark, folder).select("kpi", "region", "weeks_held", "min_history_weeks", "outcome")


_GRANTS = ", ".join(f"('{p}', '{v['rows']}')" for p, v in config.ACCESS["net_revenue"].items())


@query("g5_authorisation", f"""
SELECT region, period, persona, row_scope,
  CASE WHEN NOT (row_scope = 'all' OR (row_scope = 'own_region' AND region = 'ASIA')) THEN 'NOT_AUTHORISED' END AS outcome
FROM cells_v, (VALUES {_GRANTS}) AS g(persona, row_scope)
""")
def g5(spark, folder):
    cells = region_cells(spark, folder).select("region", "period")
    return gates.authorisation_gate(cells, "net_revenue", "ASIA")


_RUN_SQL = f"""
(SELECT *, CASE WHEN material THEN row_number() OVER (PARTITION BY kpi, region, material, island ORDER BY period) ELSE 0 END AS run_length
 FROM (
  SELECT *, CASE WHEN material THEN (year(period) * 12 + month(period))
    - row_number() OVER (PARTITION BY kpi, region, material ORDER BY period) END AS island
  FROM (SELECT * REPLACE (coalesce(material, false) AS material) FROM {_MATERIAL_SQL})
 ))
"""


def persistent_cells(spark, folder, per_store: DataFrame | None = None, revenue_only: bool = False) -> DataFrame:
    cells = material_cells(spark, folder, per_store, revenue_only).withColumn("breach", F.coalesce("material", F.lit(False))).drop("outcome")
    number = F.year("period") * 12 + F.month("period")
    return gates.persistence_gate(cells, ["kpi", "region"], F.col("persistence_periods"), number)


@query("g6_persistence", f"""
SELECT kpi, region, period, material AS breach, run_length,
  CASE WHEN material AND run_length < persistence_periods THEN 'NOT_PERSISTENT' END AS outcome FROM {_RUN_SQL}
""")
def g6(spark, folder):
    return persistent_cells(spark, folder).select(
        "kpi", "region", "period", "breach", F.col("run_length").cast("long").alias("run_length"), "outcome"
    )


@query("g7_can_open", f"""
SELECT h.kpi, region, weeks_held, materiality IS NOT NULL AND baseline_method IS NOT NULL
  AND weeks_held >= k.min_history_weeks AS can_open
FROM {_HISTORY_SQL} h JOIN kpi_v k ON k.kpi = h.kpi
""")
def g7(spark, folder):
    held = history(spark, folder).select("kpi", "region", "weeks_held")
    return gates.can_open(held, config.kpi_table(spark)).select("kpi", "region", "weeks_held", "can_open")


@query("g8_freshness", """
SELECT feed, store_id, round(age, 6) AS age_hours, round(greatest(0.0, least(1.0, (96.0 - round(age, 6)) / 72.0)) + 1e-9, 6) AS credit,
  round(age, 6) > 48 AS stale
FROM (
  SELECT feed, store_id, (epoch_us((SELECT max(ts) FROM feeds_v)) - epoch_us(max(ts))) / 3.6e9 AS age FROM feeds_v GROUP BY 1, 2
)
""")
def g8(spark, folder):
    feed = standins.feed_events(spark, folder)
    as_of = feed.agg(F.max("ts").alias("as_of"))
    return gates.freshness(feed, ["feed", "store_id"], "ts", as_of, "net_revenue").select(
        "feed", "store_id", "age_hours", "credit", "stale"
    )


_VIEWER = ", ".join(f"('{kpi}', '{policy[config.CASE_VIEWER[0]]['rows']}')" for kpi, policy in config.ACCESS.items() if config.CASE_VIEWER[0] in policy)
VIEWS["gated_v"] = f"""
SELECT spine.kpi, spine.region, spine.period, CAST(CASE WHEN 1.0 - coalesce(s.active, 0) / e.total > 0.05 THEN 1 WHEN NOT coalesce(material, false) THEN 2
    WHEN coalesce(h.weeks_held, 0) < k.min_history_weeks THEN 3 WHEN NOT coalesce(g.row_scope = 'all' OR (g.row_scope = 'own_region' AND spine.region = '{config.CASE_VIEWER[1]}'), false) THEN 4
    WHEN coalesce(run_length, 0) < k.persistence_periods THEN 5 END AS INTEGER) AS gate_id
FROM (
  SELECT kpi, region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period
  FROM (SELECT DISTINCT kpi FROM {KPI_CELLS_SQL}), (SELECT DISTINCT region FROM stores_v),
    (SELECT date_trunc('month', min(txn_date)) AS lo, date_trunc('month', max(txn_date)) AS hi FROM scope_v)) spine
JOIN kpi_v k ON k.kpi = spine.kpi
LEFT JOIN (VALUES {_VIEWER}) AS g(kpi, row_scope) ON g.kpi = spine.kpi
JOIN (SELECT region, count(*) AS total FROM stores_v GROUP BY 1) e ON e.region = spine.region
LEFT JOIN {_RUN_SQL} c ON c.kpi = spine.kpi AND c.region = spine.region AND c.period = spine.period
LEFT JOIN (SELECT region, count(DISTINCT date_trunc('week', txn_date)) AS weeks_held FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1) h
  ON h.region = spine.region
LEFT JOIN (SELECT region, CAST(date_trunc('month', txn_date) AS DATE) AS period, count(DISTINCT store_id) AS active
  FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1, 2) s ON s.region = spine.region AND s.period = spine.period
"""


def gated_cells(spark, folder, revenue_only: bool = False, per_store: DataFrame | None = None) -> DataFrame:
    """All gates over every (KPI, region, month) cell, on a dense spine: a feed
    is missing when a store of the region sold nothing that month, and a month
    without any sale is an incident, not an absent row.  Store-months are
    written once and serve the KPIs, the feed check and the history check; given
    ones need no units if revenue is the only KPI."""
    per_store = written(store_months(spark, folder) if per_store is None else per_store, "store-months")
    stores = standins.stores(spark, folder).select("store_id", "region")
    estate = stores.groupBy("region").agg(F.count(F.lit(1)).alias("total"))
    active = (
        per_store.join(stores, "store_id").groupBy("region", "period").agg(F.count(F.lit(1)).alias("active"))
    )
    held = gates.weeks_held(per_store.join(stores, "store_id"), REGION, "period", "weeks")
    runs = written(persistent_cells(spark, folder, per_store, revenue_only), "gate-runs")
    bounds = per_store.agg(F.sequence(F.min("period"), F.max("period"), F.expr("INTERVAL 1 MONTH")).alias("months"))
    limits = config.kpi_table(spark).select("kpi", "min_history_weeks", "persistence_periods")
    spine = estate.join(F.broadcast(runs.select("kpi").distinct().join(F.broadcast(bounds)))).select(
        "kpi", "region", "total", F.explode("months").alias("period"))
    cells = (
        spine.join(F.broadcast(limits), "kpi")
        .join(runs.select("kpi", "region", "period", "material", "run_length"), ["kpi", "region", "period"], "left")
        .join(active, ["region", "period"], "left").join(held, "region", "left")
        .withColumn("missing_share", 1.0 - F.coalesce("active", F.lit(0)) / F.col("total"))
        .withColumn("weeks_held", F.coalesce("weeks_held", F.lit(0)))
        .withColumn("run_length", F.coalesce("run_length", F.lit(0)))
        .withColumn("authorised", gates.may_see(F.col("kpi"), F.col("region"), *config.CASE_VIEWER))
    )
    return gates.gate_outcome(cells)


@query("g9_gate_outcome", """
SELECT kpi, region, period, gate_id, CASE gate_id WHEN 1 THEN 'DATA_INCIDENT' WHEN 2 THEN 'IMMATERIAL' WHEN 3 THEN 'INSUFFICIENT_HISTORY'
    WHEN 4 THEN 'NOT_AUTHORISED' WHEN 5 THEN 'NOT_PERSISTENT' END AS outcome FROM gated_v
""")
def g9(spark, folder):
    return gated_cells(spark, folder).select("kpi", "region", "period", "gate_id", "outcome")


# --- E: evidence -------------------------------------------------------------
@query("e1_before_after", """
SELECT region, round(avg(CASE WHEN snapshot_date < DATE '1998-06-01' THEN a END), 6) AS before,
  round(avg(CASE WHEN snapshot_date >= DATE '1998-06-01' THEN a END), 6) AS after,
  round(avg(CASE WHEN snapshot_date < DATE '1998-06-01' THEN a END) - avg(CASE WHEN snapshot_date >= DATE '1998-06-01' THEN a END), 6) AS gap
FROM (SELECT store_id, snapshot_date, CASE WHEN on_hand_units > 0 THEN 1.0 ELSE 0.0 END AS a FROM inv_v)
JOIN stores_v USING (store_id) GROUP BY 1
""")
def e1(spark, folder):
    late = F.col("snapshot_date") >= F.lit(standins.CASE_ONSET).cast("date")
    per_store = standins.inventory(spark, folder).groupBy("store_id", late.alias("late")).agg(
        count_true(F.col("on_hand_units") > 0).alias("ok"), F.count(F.lit(1)).alias("n")
    )
    share = lambda when: ratio(F.sum(F.when(when, F.col("ok"))).cast("double"), F.sum(F.when(when, F.col("n"))))
    return per_store.join(standins.stores(spark, folder).select("store_id", "region"), "store_id").groupBy("region").agg(
        share(~F.col("late")).alias("before"), share(F.col("late")).alias("after")
    ).select("region", r("before"), r("after"), rounded(F.col("before") - F.col("after")).alias("gap"))


@query("e2_flag_notes", f"""
SELECT note_id, store_id, note_group, note_date, regexp_matches(body, '{NOTE_PATTERN}', 'i') AS flagged FROM notes_v
""")
def e2(spark, folder):
    return evidence.flag_notes(standins.notes(spark, folder), NOTE_PATTERN).select(
        "note_id", "store_id", "note_group", "note_date", "flagged"
    )


@query("e3_flagged_stores", f"""
SELECT note_group, count(DISTINCT store_id) AS stores,
  count(DISTINCT CASE WHEN regexp_matches(body, '{NOTE_PATTERN}', 'i') THEN store_id END) AS flagged_stores
FROM notes_v WHERE note_date >= DATE '2024-03-01' GROUP BY 1
""")
def e3(spark, folder):
    flagged = evidence.flag_notes(standins.notes(spark, folder), NOTE_PATTERN)
    return evidence.flagged_stores(flagged, "note_group", "store_id", "2024-03-01")


_CHI_SQL = f"""
(SELECT *, a + b + c + d AS n, abs(a * d - b * c) AS spread, (a + b) * (c + d) * (a + c) * (b + d) AS margins FROM (
  SELECT store_id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(sum(a) OVER () - a AS DOUBLE) AS c,
    CAST(sum(b) OVER () - b AS DOUBLE) AS d FROM (
    SELECT store_id, count(*) FILTER (WHERE f) AS a, count(*) FILTER (WHERE NOT f) AS b
    FROM (SELECT store_id, regexp_matches(body, '{NOTE_PATTERN}', 'i') AS f FROM notes_v) GROUP BY 1
  )))
"""


def note_counts(spark, folder) -> DataFrame:
    flagged = evidence.flag_notes(standins.notes(spark, folder), NOTE_PATTERN)
    return evidence.chi_square_2x2(evidence.two_by_two(flagged, "store_id"))


@query("e4_chi_square", f"""
SELECT store_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d,
  round(n * greatest(0.0, spread - n / 2.0) * greatest(0.0, spread - n / 2.0) / nullif(margins, 0), 6) AS chi2,
  round(n * spread * spread / nullif(margins, 0), 6) AS chi2_uncorrected FROM {_CHI_SQL}
""")
def e4(spark, folder):
    return note_counts(spark, folder).select("store_id", "a", "b", "c", "d", r("chi2"), r("chi2_uncorrected"))


# The tail of chi-square with one degree of freedom is the complement of the error
# function at sqrt(chi2 / 2), here by the midpoint rule.
@query("e4_chi_square_p", f"""
SELECT store_id, round(chi2, 6) AS chi2,
  round(1.0 - (SELECT sum(exp(-pow(sqrt(chi2 / 2) * (k + 0.5) / 8000, 2))) * sqrt(chi2 / 2) / 8000 FROM range(8000) AS r(k)) * 2 / sqrt(pi()), 4) AS p_value
FROM (SELECT store_id, n * greatest(0.0, spread - n / 2.0) * greatest(0.0, spread - n / 2.0) / nullif(margins, 0) AS chi2 FROM {_CHI_SQL})
""")
def e4_p(spark, folder):
    return note_counts(spark, folder).select("store_id", r("chi2"), F.round(p_chi2_1("chi2"), 4).alias("p_value"))


@query("e5_ticket_growth", f"""
SELECT c.ticket_class, c.period, c.tickets, p.tickets AS previous,
  round(100.0 * (c.tickets / p.tickets - 1.0), 6) AS growth_pct
FROM tickets_v c LEFT JOIN tickets_v p ON p.ticket_class = c.ticket_class
  AND p.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
""")
def e5(spark, folder):
    return evidence.ticket_growth(standins.notes(spark, folder), "note_date", TICKET_PATTERN).select(
        "ticket_class", "period", "tickets", "previous", "growth_pct"
    )


_CONFUSION_SQL = f"""
(SELECT CASE WHEN n_chars >= 500 AND NOT regexp_matches(body, '{NOTE_PATTERN}', 'i') THEN 1 ELSE 0 END AS predicted,
  quality AS reviewed, count(*) AS items FROM notes_v JOIN labels ON doc_id = note_id GROUP BY 1, 2)
"""


def label_confusion(spark, folder) -> DataFrame:
    """Rule-based class (long enough and unflagged) against the reviewed label."""
    flagged = evidence.flag_notes(standins.notes(spark, folder), NOTE_PATTERN)
    predicted = flagged.select(
        F.col("note_id").alias("doc_id"),
        F.when((F.col("n_chars") >= 500) & ~F.col("flagged"), 1).otherwise(0).alias("predicted"),
    )
    truth = tables.read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("reviewed"))
    return evidence.confusion(predicted, truth, "doc_id")


@query("e6_confusion", f"SELECT * FROM {_CONFUSION_SQL}")
def e6_confusion(spark, folder):
    return label_confusion(spark, folder)


@query("e6_mislabel_rate", f"""
SELECT reviewed, CAST(sum(items) AS BIGINT) AS items,
  CAST(sum(CASE WHEN predicted <> reviewed THEN items ELSE 0 END) AS BIGINT) AS mislabelled,
  round(sum(CASE WHEN predicted <> reviewed THEN items ELSE 0 END) / sum(items), 6) AS mislabel_rate FROM {_CONFUSION_SQL} GROUP BY 1
""")
def e6(spark, folder):
    return evidence.mislabel_rate(label_confusion(spark, folder))


@query("e7_corroborate", """
SELECT e.hypothesis, e.kind, CASE WHEN e.kind = 'store_note' AND n.independent_notes >= 20
  THEN 'corroborated_unstructured' ELSE e.kind END AS kind_after, n.independent_notes, count(*) AS items
FROM evid_v e LEFT JOIN (
  SELECT hypothesis, count(DISTINCT source_ref) AS independent_notes FROM evid_v WHERE kind = 'store_note' GROUP BY 1
) n USING (hypothesis) GROUP BY 1, 2, 3, 4
""")
def e7(spark, folder):
    return evidence.corroborate(standins.evidence(spark, folder)).groupBy(
        "hypothesis", "kind", "kind_after", "independent_notes"
    ).agg(F.count(F.lit(1)).alias("items"))


@query("e8_evidence_weight", """
SELECT hypothesis, count(*) AS items, round(avg(reliability), 6) AS mean_reliability,
  round(avg(CASE WHEN reliability < 0.6 THEN 1.0 ELSE 0.0 END), 6) AS low_share,
  round(avg(CASE WHEN reliability < 0.6 THEN 1.0 ELSE 0.0 END), 6) > 0.5 AS dominated
FROM evid_v JOIN tier_v USING (kind) GROUP BY 1
""")
def e8(spark, folder):
    return evidence.evidence_weight(standins.evidence(spark, folder), config.reliability_table(spark))


@query("e9_spend_shift", f"""
SELECT region, round(before, 4) AS before, round(after, 4) AS after, round(100.0 * (after / nullif(before, 0) - 1.0), 6) AS change_pct
FROM (
  SELECT region, avg(CASE WHEN week_start < DATE '{CUT_DATE}' THEN spend END) AS before,
    avg(CASE WHEN week_start >= DATE '{CUT_DATE}' THEN spend END) AS after
  FROM (
    SELECT r_name AS region, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, round(sum(o_totalprice) / 1e5, 6) AS spend
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
  ) GROUP BY 1
)
""")
def e9(spark, folder):
    """Order value as weekly spend, combined per customer before regions attach."""
    orders = tables.read_table(spark, folder, "orders")
    per_customer = orders.groupBy("o_custkey", F.date_trunc("week", "o_orderdate").cast("date").alias("week_start")).agg(
        F.sum("o_totalprice").alias("spend")
    )
    weekly = per_customer.join(customer_regions(spark, folder), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "region", "week_start"
    ).agg(F.round(F.sum("spend") / config.LAKH, 6).alias("spend"))
    return evidence.spend_shift(weekly, REGION, CUT_DATE).select(
        "region", r("before", 4), r("after", 4), r("change_pct")
    )


@query("e10_estate_coverage", """
SELECT region, count(*) AS stores, count(*) FILTER (WHERE has_footfall_counter) AS instrumented,
  round(avg(CASE WHEN has_footfall_counter THEN 1.0 ELSE 0.0 END), 6) AS instrumented_share FROM stores_v GROUP BY 1
""")
def e10(spark, folder):
    return evidence.estate_coverage(standins.stores(spark, folder))


@query("e10_footfall_coverage", """
SELECT footfall_date, count(*) AS store_days, count(*) FILTER (WHERE counter_installed) AS instrumented,
  count(*) FILTER (WHERE footfall IS NULL) AS null_footfall,
  round(avg(CASE WHEN counter_installed THEN 1.0 ELSE 0.0 END), 6) AS instrumented_share FROM visits_v GROUP BY 1
""")
def e10_footfall(spark, folder):
    return evidence.coverage(standins.visits(spark, folder))


@query("e11_news_counts", """
SELECT CAST(year(d) AS INTEGER) AS fiscal_year, CAST(quarter(d) AS INTEGER) AS fiscal_quarter, store_id AS competitor, count(*) AS items
FROM (SELECT store_id, CAST(date_trunc('month', note_date) AS DATE) - INTERVAL 3 MONTH AS d FROM notes_v) GROUP BY 1, 2, 3
""")
def e11(spark, folder):
    return evidence.news_counts(standins.notes(spark, folder), "note_date", "store_id")


@query("e12_contradictions", """
SELECT hypothesis, count(*) FILTER (WHERE net > 0) AS supporting, count(*) FILTER (WHERE net < 0) AS opposing,
  count(*) FILTER (WHERE net > 0) > 0 AND count(*) FILTER (WHERE net < 0) > 0
    AND count(*) FILTER (WHERE net > 0) + count(*) FILTER (WHERE net < 0) >= 2 AS contradictory
FROM (SELECT hypothesis, source_ref, sum(sign) AS net FROM evid_v GROUP BY 1, 2) GROUP BY 1
""")
def e12(spark, folder):
    return evidence.contradictions(standins.evidence(spark, folder))


@query("e13_concordance", """
SELECT hypothesis, count(*) AS pairs, round(avg(CASE WHEN s.sign = u.sign THEN 1.0 ELSE 0.0 END), 6) AS concordance
FROM (SELECT * FROM evid_v WHERE kind IN ('structured_query', 'derived_estimate') AND sign <> 0) s
JOIN (SELECT * FROM evid_v WHERE kind NOT IN ('structured_query', 'derived_estimate') AND sign <> 0) u USING (hypothesis)
GROUP BY 1
""")
def e13(spark, folder):
    """Pair agreement from four counts; the SQL twin enumerates the pairs."""
    return evidence.concordance(standins.evidence(spark, folder)).where("pairs > 0")


@query("e14_lineage", """
SELECT evidence_id, 0 AS step, 'sql' AS operation, unnest([source_ref, kind]) AS input FROM evid_v
UNION ALL SELECT evidence_id, 1, 'aggregate', hypothesis FROM evid_v
UNION ALL SELECT evidence_id, 2, 'publish', NULL FROM evid_v
""")
def e14(spark, folder):
    step = lambda op, *inputs: F.struct(
        F.lit(op).alias("operation"), F.array(*inputs).cast("array<string>").alias("inputs")
    )
    nested = standins.evidence(spark, folder).select("evidence_id", F.array(
        step("sql", F.col("source_ref"), F.col("kind")), step("aggregate", F.col("hypothesis")), step("publish"),
    ).alias("lineage"))
    return evidence.lineage(nested)

