"""Queries over sources, conformed facts and KPIs (S, C and K operators)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import crore, price, ratio, rounded, steady
from kpisleuth.operators import conform, gates, kpis
from kpisleuth.plans.registry import query
from kpisleuth.session import scratch_path, written
from kpisleuth.sources import standins, tables

# Stand-in festival dates: the configured windows of one year, repeated for the
# years the sales cover.  Config regions are mapped onto the given regions.
SALES_YEARS = range(1995, 2002)
REGION_OF = {"AFRICA": "North", "AMERICA": "South", "ASIA": "East", "EUROPE": "West", "MIDDLE EAST": "West"}


def festival_windows() -> dict:
    def moved(day: date, years: int) -> date:
        return day.replace(year=day.year + years)

    out = {}
    for name, spans in config.FESTIVALS.items():
        start, end = spans[0]
        out[name] = [(moved(start, y - start.year), moved(end, y - start.year)) for y in SALES_YEARS]
    return out


FESTIVAL_SPANS = [span for spans in festival_windows().values() for span in spans]
FESTIVAL_DAY_ROWS = ", ".join(
    f"('{name}', DATE '{start + timedelta(days=i)}')"
    for name, spans in festival_windows().items()
    for start, end in spans
    for i in range((end - start).days + 1)
)
FESTIVAL_WINDOW_ROWS = ", ".join(
    f"('{name}', DATE '{start}', DATE '{end}', {config.FESTIVAL_PEAK[name]})"
    for name, spans in festival_windows().items()
    for start, end in spans
)
INTENSITY_ROWS = ", ".join(
    f"('{name}', '{region}', {by_region[source]})"
    for name, by_region in config.FESTIVAL_INTENSITY.items()
    for region, source in REGION_OF.items()
)


def conformed(spark: SparkSession, folder: str) -> DataFrame:
    return conform.with_net(conform.in_scope(standins.sales(spark, folder)))


def sales_days(spark: SparkSession, folder: str) -> DataFrame:
    """Every day between the first and last sale."""
    orders = tables.read_table(spark, folder, "orders")
    bounds = conform.day_bounds(orders.select(F.col("o_orderdate").cast("date").alias("d")), "d")
    return conform.days_from(bounds, "first_day", "last_day")


DAYS_SQL = """
(SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
 FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders))
"""


# --- S: sources and sinks ---------------------------------------------------
@query("s1_read_table", """
SELECT l_returnflag, l_linestatus, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity,
  CAST(min(l_shipdate) AS DATE) AS first_ship FROM lineitem GROUP BY 1, 2
""")
def s1(spark, folder):
    return tables.read_table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"),
        F.min("l_shipdate").cast("date").alias("first_ship"),
    )


@query("s2_export_canonical", "SELECT region, CAST(period AS VARCHAR) AS period, round(value, 4) AS total_cr FROM cells_v")
def s2(spark, folder):
    """Export region-month totals as CSV and read them back with a declared schema."""
    totals = k10(spark, folder).select("region", F.col("period").cast("string").alias("period"), "total_cr")
    path = tables.export_canonical(totals, ["region", "period"], scratch_path(spark, "export"))
    return spark.read.schema(totals.schema).option("header", True).csv(path)


@query("s3_manifest", """
SELECT 'lineitem' AS table_name, count(*) AS rows, round(sum(l_quantity), 2) AS measured_total FROM lineitem
UNION ALL SELECT 'orders', count(*), round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'part', count(*), round(sum(p_retailprice), 2) FROM part
UNION ALL SELECT 'events', count(*), round(sum(value), 2) FROM events
""")
def s3(spark, folder):
    read = lambda name: tables.read_table(spark, folder, name)
    return tables.manifest({
        "lineitem": (read("lineitem"), F.col("l_quantity")),
        "orders": (read("orders"), F.col("o_totalprice")),
        "part": (read("part"), F.col("p_retailprice")),
        "events": (read("events"), F.col("value")),
    })


@query("s4_with_thresholds", """
SELECT region, period, value, c.kpi, materiality, materiality_unit, persistence_periods, min_history_weeks
FROM (SELECT 'net_revenue' AS kpi, * FROM cells_v) c LEFT JOIN kpi_v k ON c.kpi = k.kpi
""")
def s4(spark, folder):
    cells = region_cells(spark, folder).withColumn("kpi", F.lit("net_revenue"))
    return gates.with_thresholds(cells, config.kpi_table(spark)).select(
        "region", "period", "value", "kpi", "materiality", "materiality_unit", "persistence_periods", "min_history_weeks"
    )


# --- C: conform -------------------------------------------------------------
@query("c1_in_scope", """
SELECT channel, txn_type, count(*) AS lines, round(sum(gross_amount) / 1e7, 6) AS gross_cr
FROM sales_v WHERE channel <> 'B2B' AND txn_type <> 'TRANSFER' GROUP BY 1, 2
""")
def c1(spark, folder):
    return conform.in_scope(standins.sales(spark, folder)).groupBy("channel", "txn_type").agg(
        F.count(F.lit(1)).alias("lines"), crore(F.sum("gross_amount")).alias("gross_cr")
    )


@query("c1_in_scope_qcomm", """
SELECT channel, txn_type, count(*) AS lines FROM sales_v WHERE txn_type <> 'TRANSFER' GROUP BY 1, 2
""")
def c1_qcomm(spark, folder):
    """The quick-commerce contract keeps wholesale."""
    kept = conform.in_scope(standins.sales(spark, folder), "qcomm_fulfilment_rate")
    return kept.groupBy("channel", "txn_type").agg(F.count(F.lit(1)).alias("lines"))


@query("c2_net_amount", """
SELECT txn_id, sku_id, store_id, units, round(gross_amount, 6) AS gross_amount,
  round(gross_amount - returns_amount - discount_amount - tax_amount, 6) AS net_amount FROM sales_v
""")
def c2(spark, folder):
    return conform.with_net(standins.sales(spark, folder)).select(
        "txn_id", "sku_id", "store_id", "units", rounded(F.col("gross_amount")).alias("gross_amount"),
        rounded(F.col("net_amount")).alias("net_amount"),
    )


@query("c3_store_code_changes", """
SELECT store_id, count(*) AS codes, arg_max(store_code, first_seen) AS latest_code, max(first_seen) AS changed_on
FROM (SELECT store_id, store_code, min(txn_date) AS first_seen FROM sales_v GROUP BY 1, 2)
GROUP BY 1 HAVING count(*) > 1
""")
def c3(spark, folder):
    return conform.store_code_changes(standins.sales(spark, folder))


@query("c4_processed_period", """
SELECT store_id, CAST(date_trunc('month', day) AS DATE) AS period, round(sum(sold) / 1e7, 6) AS sold_cr,
  round(sum(returned) / 1e7, 6) AS returned_cr, round(sum(sold - returned) / 1e7, 6) AS net_cr
FROM (
  SELECT store_id, txn_date AS day, gross_amount - discount_amount - tax_amount AS sold, 0.0 AS returned
  FROM sales_v WHERE channel <> 'B2B' AND txn_type <> 'TRANSFER'
  UNION ALL
  SELECT store_id, posted_date, 0.0, returns_amount FROM sales_v
  WHERE channel <> 'B2B' AND txn_type <> 'TRANSFER' AND returns_amount <> 0
) GROUP BY 1, 2
""")
def c4(spark, folder):
    return conform.net_by_processed_period(
        conform.in_scope(standins.sales(spark, folder)), "monthly", ["store_id"]
    )


@query("c5_restatement_audit", """
SELECT lag_days, lines, round(amount / 1e7, 6) AS amount_cr, round(lines / sum(lines) OVER (), 6) AS line_share,
  round(CASE WHEN lag_days > 0 THEN amount ELSE 0.0 END / sum(amount) OVER (), 6) AS missed_same_day_share
FROM (
  SELECT CAST(posted_date - txn_date AS INTEGER) AS lag_days, count(*) AS lines, sum(returns_amount) AS amount
  FROM sales_v WHERE returns_amount > 0 GROUP BY 1
)
""")
def c5(spark, folder):
    return conform.restatement_audit(standins.sales(spark, folder))


@query("c6_reweight_sample", """
SELECT store_id, count(*) AS sampled_lines, round(sum(gross_amount / 0.02) / 1e7 + 1e-9, 6) AS estimate_cr
FROM sales_v WHERE CAST('0x' || substr(md5(CAST(txn_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.02
GROUP BY 1
""")
def c6(spark, folder):
    sampled = conform.hash_sample(standins.sales(spark, folder), "txn_id", config.BILL_SAMPLE_RATE)
    return conform.reweight(sampled, ["store_id"], F.col("gross_amount"))


_CALENDAR_SQL = f"""
SELECT d.date, CAST(year(d.date) AS INTEGER) AS year, CAST(month(d.date) AS INTEGER) AS month,
  CAST(day(d.date) AS INTEGER) AS day, CAST(isodow(d.date) - 1 AS INTEGER) AS dow,
  CAST(isoyear(d.date) AS INTEGER) AS iso_year, CAST(weekofyear(d.date) AS INTEGER) AS iso_week,
  strftime(d.date, '%Y-%m') AS period_month, CAST(fy AS INTEGER) AS fiscal_year,
  'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS fiscal_year_label,
  CAST((month(d.date) + 8) % 12 // 3 + 1 AS INTEGER) AS fiscal_quarter, isodow(d.date) >= 6 AS is_weekend,
  d.date = last_day(d.date) AS is_month_end, day(d.date) IN (1, 2, 30, 31) AS is_payday,
  coalesce(f.festivals, '') AS festivals, coalesce(f.festivals, '') <> '' AS is_festival
FROM (SELECT date, year(date) - CASE WHEN month(date) < 4 THEN 1 ELSE 0 END AS fy FROM {DAYS_SQL}) d
LEFT JOIN (
  SELECT date, string_agg(DISTINCT festival, '|' ORDER BY festival) AS festivals
  FROM (VALUES {FESTIVAL_DAY_ROWS}) AS t(festival, date) GROUP BY 1
) f ON f.date = d.date
"""


@query("c7_calendar", _CALENDAR_SQL)
def c7(spark, folder):
    return conform.calendar(
        sales_days(spark, folder), config.festival_window_table(spark, festival_windows())
    )


@query("c8_densify", """
SELECT s.store_id, s.date, f.lines, round(f.net / 1e7, 6) AS net_cr FROM (
  SELECT store_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM stores_v, (SELECT min(txn_date) AS lo, max(txn_date) AS hi FROM scope_v)
) s LEFT JOIN (
  SELECT store_id, txn_date AS date, count(*) AS lines, sum(net) AS net FROM scope_v GROUP BY 1, 2
) f ON f.store_id = s.store_id AND f.date = s.date
""")
def c8(spark, folder):
    facts = conformed(spark, folder)
    daily = written(facts.groupBy("store_id", F.col("txn_date").alias("date")).agg(
        F.count(F.lit(1)).alias("lines"), crore(F.sum("net_amount")).alias("net_cr")
    ), "store-days")
    members = standins.stores(spark, folder).select("store_id")
    return conform.densify(daily, members, conform.day_bounds(daily, "date"), ["store_id"], "date")


@query("c8_densify_feeds", """
SELECT s.store_id, s.feed, s.feed_date, f.items FROM (
  SELECT store_id, feed, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS feed_date
  FROM (SELECT DISTINCT store_id, feed FROM feeds_v), (SELECT min(feed_date) AS lo, max(feed_date) AS hi FROM feeds_v)
) s LEFT JOIN (SELECT store_id, feed, feed_date, count(*) AS items FROM feeds_v GROUP BY 1, 2, 3) f
  ON f.store_id = s.store_id AND f.feed = s.feed AND f.feed_date = s.feed_date
""")
def c8_feeds(spark, folder):
    """Every (store, feed) on every day; silent days stay visible as nulls."""
    feed = standins.feed_events(spark, folder)
    daily = written(feed.groupBy("store_id", "feed", "feed_date").agg(F.count(F.lit(1)).alias("items")), "feed-days")
    members = daily.select("store_id", "feed").distinct()
    return conform.densify(daily, members, conform.day_bounds(daily, "feed_date"), ["store_id", "feed"], "feed_date")


@query("c9_reconcile", """
SELECT coalesce(d.txn_id, t.txn_id) AS txn_id, round(detail_amount, 2) AS detail_amount,
  total_amount, round(coalesce(detail_amount, 0.0) - coalesce(total_amount, 0.0), 2) AS gap
FROM (SELECT l_orderkey AS txn_id, sum(l_extendedprice) AS detail_amount FROM lineitem GROUP BY 1) d
FULL OUTER JOIN (SELECT o_orderkey AS txn_id, o_totalprice AS total_amount FROM orders) t ON d.txn_id = t.txn_id
WHERE detail_amount IS NULL OR total_amount IS NULL
  OR abs(coalesce(detail_amount, 0.0) - coalesce(total_amount, 0.0)) > 1000.0
""")
def c9(spark, folder):
    detail = tables.read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("txn_id"), F.col("l_extendedprice").alias("amount")
    )
    total = tables.read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("txn_id"), F.col("o_totalprice").alias("amount")
    )
    return conform.reconcile(detail, total, ["txn_id"], 1000.0).select(
        "txn_id", F.round("detail_amount", 2).alias("detail_amount"), "total_amount", F.round("gap", 2).alias("gap")
    )


_WEIGHTS_SQL = """
SELECT i.store_id, i.period, i.sku_id, i.share * (0.35 + 0.65 * coalesce(i.availability / nullif(b.best, 0), 1.0)) AS weight
FROM (
  SELECT store_id, CAST(date_trunc('month', snapshot_date) AS DATE) AS period, sku_id, count(*) AS share,
    avg(CASE WHEN on_hand_units > 0 THEN 1.0 ELSE 0.0 END) AS availability FROM inv_v GROUP BY 1, 2, 3
) i JOIN (
  SELECT sku_id, max(availability) AS best FROM (
    SELECT store_id, CAST(date_trunc('month', snapshot_date) AS DATE) AS period, sku_id,
      avg(CASE WHEN on_hand_units > 0 THEN 1.0 ELSE 0.0 END) AS availability FROM inv_v GROUP BY 1, 2, 3
  ) GROUP BY 1
) b ON b.sku_id = i.sku_id
"""


@query("c10_allocate", f"""
SELECT w.store_id, w.period, w.sku_id, round(w.weight, 6) AS weight, round(t.amount * w.weight / nullif(s.total, 0) + 1e-9, 6) AS allocated
FROM ({_WEIGHTS_SQL}) w
JOIN (SELECT store_id, period, sum(weight) AS total FROM ({_WEIGHTS_SQL}) GROUP BY 1, 2) s
  ON s.store_id = w.store_id AND s.period = w.period
JOIN (SELECT store_id, CAST(date_trunc('month', txn_date) AS DATE) AS period, round(sum(net) / 1e5, 6) AS amount
      FROM scope_v GROUP BY 1, 2) t ON t.store_id = w.store_id AND t.period = w.period
""")
def c10(spark, folder):
    """Store-month revenue (in lakh) split over the SKUs held, by share and availability."""
    month = F.date_trunc("month", "snapshot_date").cast("date").alias("period")
    held = written(standins.inventory(spark, folder).groupBy("store_id", month, "sku_id").agg(
        F.count(F.lit(1)).alias("share"),
        F.avg(F.when(F.col("on_hand_units") > 0, 1.0).otherwise(0.0)).alias("availability"),
    ), "shelf-months")
    best = held.groupBy("sku_id").agg(F.max("availability").alias("best"))
    weight = conform.allocation_weight(F.col("share"), F.col("availability"), F.col("best"))
    weights = held.join(best, "sku_id").select("store_id", "period", "sku_id", weight.alias("weight"))
    total = conformed(spark, folder).groupBy(
        "store_id", F.date_trunc("month", "txn_date").cast("date").alias("period")
    ).agg(F.round(F.sum("net_amount") / config.LAKH, 6).alias("amount"))
    return conform.allocate(total, weights, ["store_id", "period"]).select(
        "store_id", "period", "sku_id", rounded(F.col("weight")).alias("weight"),
        steady(F.col("allocated")).alias("allocated"),
    )


@query("c11_control_total", """
SELECT s.region, s.period, s.amount, round(t.target / nullif(x.total, 0), 6) AS factor,
  round(s.amount * t.target / nullif(x.total, 0), 4) AS benchmarked
FROM (SELECT region, period, value AS amount FROM cells_v) s
JOIN (SELECT region, sum(value) AS total FROM cells_v GROUP BY 1) x ON x.region = s.region
JOIN (SELECT r_name AS region, round(sum(o_totalprice) / 1e7, 6) AS target FROM orders JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) t ON t.region = s.region
""")
def c11(spark, folder):
    """Region-month series scaled to the ledger total of the region."""
    return conform.to_control_total(
        written(region_cells(spark, folder).withColumnRenamed("value", "amount"), "cells"), ledger_totals(spark, folder), ["region"]
    ).select("region", "period", "amount", rounded(F.col("factor")).alias("factor"),
             F.round("benchmarked", 4).alias("benchmarked"))


def customer_regions(spark, folder) -> DataFrame:
    nation = tables.read_table(spark, folder, "nation")
    region = tables.read_table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.read_table(spark, folder, "customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("r_name").alias("region"))


def ledger_totals(spark, folder) -> DataFrame:
    """Order totals per customer first, so the join carries one row per customer."""
    per_customer = tables.read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return per_customer.join(customer_regions(spark, folder), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "region"
    ).agg(crore(F.sum("t")).alias("target"))


@query("c12_weeks", f"""
SELECT CAST(isoyear(date) AS INTEGER) AS iso_year, CAST(weekofyear(date) AS INTEGER) AS iso_week,
  min(date) AS week_start, count(*) AS days FROM {DAYS_SQL} GROUP BY 1, 2
""")
def c12(spark, folder):
    return conform.week_buckets(conform.calendar_columns(sales_days(spark, folder)))


@query("c12_quarters", f"""
SELECT CAST(year(date) - CASE WHEN month(date) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
  CAST((month(date) + 8) % 12 // 3 + 1 AS INTEGER) AS fiscal_quarter, min(date) AS quarter_start, count(*) AS days
FROM {DAYS_SQL} GROUP BY 1, 2
""")
def c12_quarters(spark, folder):
    return conform.quarter_buckets(conform.calendar_columns(sales_days(spark, folder)))


# --- K: KPIs ----------------------------------------------------------------
def _monthly_sql(select: str, extra: str = "") -> str:
    return f"""
SELECT region, store_id, CAST(date_trunc('month', txn_date) AS DATE) AS period, {select}
FROM scope_v JOIN stores_v USING (store_id) {extra} GROUP BY 1, 2, 3
"""


@query("k1_net_revenue", _monthly_sql("round(sum(net) / 1e7, 6) AS net_revenue_inr_cr"))
def k1(spark, folder):
    return kpis.net_revenue(standins.sales(spark, folder), standins.stores(spark, folder))


@query("k2_transactions", _monthly_sql("count(DISTINCT txn_id) AS transactions"))
def k2(spark, folder):
    return kpis.transactions(standins.sales(spark, folder), standins.stores(spark, folder))


_EVENT_STORES = "(SELECT DISTINCT user_id AS store_id, 'R' || (user_id % 5) AS region FROM events)"


def event_stores(spark, folder) -> DataFrame:
    """Stores of the event tables, with a region from the id."""
    return tables.read_table(spark, folder, "events").select(F.col("user_id").alias("store_id")).distinct().select(
        "store_id", F.concat(F.lit("R"), (F.col("store_id") % 5).cast("string")).alias("region")
    )


@query("k3_conversion_rate", f"""
SELECT region, store_id, CAST(date_trunc('week', footfall_date) AS DATE) AS period,
  CAST(sum(coalesce(bills, 0)) AS BIGINT) AS bills, CAST(sum(visits) AS BIGINT) AS visits,
  round(100.0 * sum(coalesce(bills, 0)) / nullif(sum(visits), 0), 6) AS conversion_rate_pt
FROM (SELECT store_id, footfall_date, sum(footfall) AS visits FROM visits_v WHERE counter_installed GROUP BY 1, 2)
LEFT JOIN (SELECT store_id, txn_date AS footfall_date, count(DISTINCT txn_id) AS bills FROM tills_v
    WHERE channel <> 'B2B' AND txn_type <> 'TRANSFER' GROUP BY 1, 2)
  USING (store_id, footfall_date)
JOIN {_EVENT_STORES} USING (store_id) GROUP BY 1, 2, 3
""")
def k3(spark, folder):
    return kpis.conversion_rate(
        standins.till_events(spark, folder), standins.visits(spark, folder), event_stores(spark, folder), "weekly"
    )


@query("k4_avg_selling_price", """
SELECT region, store_id, sub_category, CAST(date_trunc('month', txn_date) AS DATE) AS period,
  round(sum(net) / nullif(sum(units), 0) + 1e-9, 4) AS avg_selling_price_inr
FROM scope_v JOIN stores_v USING (store_id) JOIN skus_v USING (sku_id) GROUP BY 1, 2, 3, 4
""")
def k4(spark, folder):
    return kpis.avg_selling_price(
        standins.sales(spark, folder), standins.stores(spark, folder), standins.skus(spark, folder)
    )


@query("k5_on_shelf_availability", """
SELECT region, store_id, CAST(date_trunc('week', snapshot_date) AS DATE) AS period,
  round(100.0 * count(*) FILTER (WHERE on_hand_units > 0) / nullif(count(*), 0), 6) AS on_shelf_availability_pct
FROM inv_v JOIN assort_v USING (sku_id) JOIN stores_v USING (store_id)
WHERE snapshot_hour = 12 AND snapshot_date BETWEEN valid_from AND valid_to GROUP BY 1, 2, 3
""")
def k5(spark, folder):
    return kpis.on_shelf_availability(
        standins.inventory(spark, folder), standins.assortment(spark, folder), standins.stores(spark, folder)
    ).drop("in_stock", "ranged")


@query("k6_qcomm_fulfilment", """
SELECT region, store_id, CAST(date_trunc('week', order_date) AS DATE) AS period, count(*) AS orders,
  round(100.0 * count(*) FILTER (WHERE lines_shipped = lines_ordered AND delivered_date <= promised_date)
    / nullif(count(*), 0), 6) AS qcomm_fulfilment_rate_pct
FROM qcomm_v JOIN stores_v ON store_id = dark_store_id WHERE txn_type <> 'TRANSFER' GROUP BY 1, 2, 3
""")
def k6(spark, folder):
    return kpis.qcomm_fulfilment(standins.qcomm_orders(spark, folder), standins.stores(spark, folder)).drop("good")


@query("k7_row_policy", _monthly_sql("round(sum(net) / 1e7, 6) AS net_revenue_inr_cr").replace(
    "GROUP BY", "WHERE region = 'ASIA' GROUP BY"))
def k7(spark, folder):
    """A regional manager sees only their region; the filter reaches the store scan."""
    return kpis.apply_row_policy(k1(spark, folder), "net_revenue", "regional_manager", {"user_region": "ASIA"})


@query("k7_row_policy_store", _monthly_sql("round(sum(net) / 1e7, 6) AS net_revenue_inr_cr").replace(
    "GROUP BY", "WHERE store_id = 7 GROUP BY"))
def k7_store(spark, folder):
    return kpis.apply_row_policy(k1(spark, folder), "net_revenue", "store_manager", {"user_store_id": 7})


@query("k8_column_mask", """
SELECT store_id, region, city, store_format, sqft, CAST(NULL AS INTEGER) AS staff_headcount,
  CAST(NULL AS DOUBLE) AS margin_pct FROM stores_v
""")
def k8(spark, folder):
    visible = standins.stores(spark, folder).select(
        "store_id", "region", "city", "store_format", "sqft", "staff_headcount",
        (F.col("size_index") / 1000.0).alias("margin_pct"),
    )
    return kpis.mask(visible, "net_revenue", "store_manager")


def _grain_sql(grain: str) -> str:
    at = lambda day: f"CAST(date_trunc('{config.GRAIN_UNIT[grain]}', {day}) AS DATE) AS period"
    sold = "FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1, 2"
    share = lambda good: f"round(100.0 * count(*) FILTER (WHERE {good}) / nullif(count(*), 0), 6) AS value"
    parts = {
        "net_revenue": f"SELECT region, {at('txn_date')}, 'net_revenue' AS kpi, round(sum(net) / 1e7, 6) AS value {sold}",
        "avg_selling_price": f"SELECT region, {at('txn_date')}, 'avg_selling_price' AS kpi, round(sum(net) / nullif(sum(units), 0) + 1e-9, 4) AS value {sold}",
        "transactions": f"SELECT region, {at('txn_date')}, 'transactions' AS kpi, CAST(count(DISTINCT txn_id) AS DOUBLE) AS value {sold}",
        "conversion_rate": f"""SELECT region, {at('footfall_date')}, 'conversion_rate' AS kpi,
          round(100.0 * sum(coalesce(bills, 0)) / nullif(sum(visits), 0), 6) AS value
        FROM (SELECT store_id, footfall_date, sum(footfall) AS visits FROM visits_v WHERE counter_installed GROUP BY 1, 2)
        LEFT JOIN (SELECT store_id, txn_date AS footfall_date, count(DISTINCT txn_id) AS bills FROM tills_v
          WHERE channel <> 'B2B' AND txn_type <> 'TRANSFER' GROUP BY 1, 2) USING (store_id, footfall_date)
        JOIN {_EVENT_STORES} USING (store_id) GROUP BY 1, 2""",
        "on_shelf_availability": f"""SELECT region, {at('snapshot_date')}, 'on_shelf_availability' AS kpi, {share('on_hand_units > 0')}
        FROM inv_v JOIN assort_v USING (sku_id) JOIN stores_v USING (store_id)
        WHERE snapshot_hour = 12 AND snapshot_date BETWEEN valid_from AND valid_to GROUP BY 1, 2""",
        "qcomm_fulfilment_rate": f"""SELECT region, {at('order_date')}, 'qcomm_fulfilment_rate' AS kpi,
          {share('lines_shipped = lines_ordered AND delivered_date <= promised_date')}
        FROM qcomm_v JOIN stores_v ON store_id = dark_store_id WHERE txn_type <> 'TRANSFER' GROUP BY 1, 2""",
    }
    return " UNION ALL ".join(text for kpi, text in parts.items() if grain in config.KPIS[kpi]["grains"])


def _grain_query(grain: str):
    @query(f"k9_kpi_{grain}", _grain_sql(grain))
    def k9(spark, folder):
        """Every KPI whose contract allows the grain, by region; ratios from additive parts."""
        sales, stores = standins.sales(spark, folder), standins.stores(spark, folder)
        rates = {
            "conversion_rate": lambda: kpis.region_rate(kpis.conversion_rate(
                standins.till_events(spark, folder), standins.visits(spark, folder), event_stores(spark, folder), grain),
                "conversion_rate", "bills", "visits"),
            "on_shelf_availability": lambda: kpis.region_rate(kpis.on_shelf_availability(
                standins.inventory(spark, folder), standins.assortment(spark, folder), stores, grain),
                "on_shelf_availability", "in_stock", "ranged"),
            "qcomm_fulfilment_rate": lambda: kpis.region_rate(kpis.qcomm_fulfilment(
                standins.qcomm_orders(spark, folder), stores, grain), "qcomm_fulfilment_rate", "good", "orders"),
        }
        found = kpis.kpis_at_grain(["net_revenue", "avg_selling_price"], sales, stores, grain).unionByName(
            kpis.region_transactions(sales, stores, grain))
        for kpi, rate in rates.items():
            if grain in config.KPIS[kpi]["grains"]:
                found = found.unionByName(rate())
        return found


for _grain in config.GRAIN_UNIT:
    _grain_query(_grain)


def region_cells(spark, folder) -> DataFrame:
    """Net revenue in crore by region and month, the base of every movement."""
    return kpis.kpis_at_grain(
        ["net_revenue"], standins.sales(spark, folder), standins.stores(spark, folder), "monthly"
    ).select("region", "period", "value")


@query("k10_region_month", "SELECT region, period, value AS total_cr FROM cells_v")
def k10(spark, folder):
    per_store = conformed(spark, folder).groupBy("store_id", "txn_date").agg(F.sum("net_amount").alias("revenue"))
    panel = per_store.join(standins.stores(spark, folder).select("store_id", "region"), "store_id")
    return kpis.region_month(panel, "revenue", "txn_date")


@query("k11_contribution", """
SELECT 'region' AS dimension, CAST(region AS VARCHAR) AS member, round((sum(after) - sum(before)) / 1e7, 6) AS delta_cr,
  round((sum(after) - sum(before)) / (SELECT sum(after) - sum(before) FROM year_pair_v), 6) AS share_of_delta
FROM year_pair_v GROUP BY region
UNION ALL SELECT 'city', city, round((sum(after) - sum(before)) / 1e7, 6),
  round((sum(after) - sum(before)) / (SELECT sum(after) - sum(before) FROM year_pair_v), 6) FROM year_pair_v GROUP BY city
UNION ALL SELECT 'category', category, round((sum(after) - sum(before)) / 1e7, 6),
  round((sum(after) - sum(before)) / (SELECT sum(after) - sum(before) FROM year_pair_v), 6) FROM year_pair_v GROUP BY category
UNION ALL SELECT 'sub_category', sub_category, round((sum(after) - sum(before)) / 1e7, 6),
  round((sum(after) - sum(before)) / (SELECT sum(after) - sum(before) FROM year_pair_v), 6) FROM year_pair_v GROUP BY sub_category
""")
def k11(spark, folder):
    """Where the change from 1997 to 1998 sits.  Lines are combined per (store,
    SKU) before dimensions are attached and grouping sets expand them."""
    facts = kpis.between(conformed(spark, folder), "txn_date", "1997-01-01", "1999-01-01")
    late = F.year("txn_date") == 1998
    pairs = facts.groupBy("store_id", "sku_id").agg(
        F.sum(F.when(~late, F.col("net_amount")).otherwise(0.0)).alias("before"),
        F.sum(F.when(late, F.col("net_amount")).otherwise(0.0)).alias("after"),
    )
    cells = written(pairs.join(standins.stores(spark, folder), "store_id").join(standins.skus(spark, folder), "sku_id").groupBy(
        "region", "city", "category", "sub_category"
    ).agg(F.sum("before").alias("before"), F.sum("after").alias("after")), "contribution-cells")
    return kpis.contribution(cells, ["region", "city", "category", "sub_category"])


CONTRACT_DIMENSIONS = ["region", "city", "store_id", "store_format", "channel", "category", "sub_category", "sku"]


@query("k11_contribution_by_year", " UNION ALL ".join(f"""
SELECT year, '{d}' AS dimension, CAST({d} AS VARCHAR) AS member, round((sum(after) - sum(before)) / 1e7, 6) AS delta_cr,
  round((sum(after) - sum(before)) / nullif(max(total_delta), 0), 6) AS share_of_delta
FROM year_pairs_v JOIN (SELECT year, sum(after) - sum(before) AS total_delta FROM year_pairs_v GROUP BY 1) USING (year) GROUP BY year, {d}
""" for d in CONTRACT_DIMENSIONS))
def k11_by_year(spark, folder):
    """Where the change between successive years sits, for all years and all dimensions of the contract."""
    facts = conformed(spark, folder).groupBy("store_id", F.col("sku_id"), "channel", F.year("txn_date").cast("long").alias("year")).agg(
        F.sum("net_amount").alias("value"))
    cells = written(facts.join(standins.stores(spark, folder), "store_id").join(standins.skus(spark, folder), "sku_id").withColumnRenamed(
        "sku_id", "sku").select(*CONTRACT_DIMENSIONS, "year", "value"), "contribution-cells")
    return kpis.contribution_by_year(cells, CONTRACT_DIMENSIONS)


_WEEK_RATE_SQL = """
(SELECT 'R' || (store_id % 5) AS region, period, 100.0 * sum(bills) / nullif(sum(visits), 0) AS rate, sum(revenue) AS revenue FROM (
  SELECT store_id, CAST(date_trunc('week', feed_date) AS DATE) AS period, count(*) FILTER (WHERE feed = 'view') AS visits,
    count(*) FILTER (WHERE feed = 'purchase' AND event_id % 10 <> 3 AND event_id % 17 <> 5) AS bills,
    coalesce(sum(amount) FILTER (WHERE feed = 'purchase' AND event_id % 10 <> 3 AND event_id % 17 <> 5), 0.0) AS revenue
  FROM feeds_v WHERE store_id % 4 = 0 GROUP BY 1, 2) GROUP BY 1, 2)
"""


@query("k12_revenue_equivalent", f"""
SELECT c.region, c.period, round(c.rate - p.rate, 6) AS residual_pt, round(p.rate, 6) AS conversion_before_pt,
  round(c.revenue, 2) AS revenue, round(abs(c.rate - p.rate) / nullif(p.rate, 0) * c.revenue + 1e-9, 4) AS revenue_equivalent
FROM {_WEEK_RATE_SQL} c JOIN {_WEEK_RATE_SQL} p ON p.region = c.region AND p.period = c.period - 7
WHERE p.rate IS NOT NULL
""")
def k12(spark, folder):
    """Week-on-week conversion change of each region, priced in revenue.

    One scan: visits, bills in scope and their revenue are conditional sums per
    store and week, for the stores with a counter.
    """
    feed = standins.feed_events(spark, folder).where(F.col("store_id") % 4 == 0)
    bill = (F.col("feed") == "purchase") & (F.col("event_id") % 10 != 3) & (F.col("event_id") % 17 != 5)
    per_store = feed.groupBy("store_id", F.date_trunc("week", "feed_date").cast("date").alias("period")).agg(
        F.count_if(F.col("feed") == "view").alias("visits"), F.count_if(bill).alias("bills"),
        F.coalesce(F.sum(F.when(bill, F.col("amount"))), F.lit(0.0)).alias("revenue"),
    )
    weekly = per_store.groupBy(F.concat(F.lit("R"), (F.col("store_id") % 5).cast("string")).alias("region"), "period").agg(
        (100.0 * F.sum("bills") / F.nullif(F.sum("visits"), F.lit(0))).alias("rate"), F.sum("revenue").alias("revenue"),
    )
    order = Window.partitionBy("region").orderBy("period")
    before = F.when(F.lag("period").over(order) == F.date_sub("period", 7), F.lag("rate").over(order))
    cells = weekly.withColumn("conversion_before_pt", before).where("conversion_before_pt IS NOT NULL").withColumn(
        "residual_pt", F.col("rate") - F.col("conversion_before_pt")
    )
    return kpis.revenue_equivalent(cells).select(
        "region", "period", rounded(F.col("residual_pt")).alias("residual_pt"),
        rounded(F.col("conversion_before_pt")).alias("conversion_before_pt"),
        F.round("revenue", 2).alias("revenue"), steady(F.col("revenue_equivalent"), 4).alias("revenue_equivalent"),
    )


_PANEL = ["net_revenue", "transactions", "avg_selling_price", "on_shelf_availability", "conversion_rate", "qcomm_fulfilment_rate"]


def _panel_sql(**given: str) -> str:
    return ", ".join(f"{given.get(name, 'NULL')} AS {name}" for name in _PANEL)


@query("k13_kpi_panel", f"""
SELECT region, store_id, period, {", ".join(f"max({name}) AS {name}" for name in _PANEL)}
FROM (
  SELECT region, store_id, CAST(date_trunc('week', txn_date) AS DATE) AS period,
    {_panel_sql(net_revenue="round(sum(net) / 1e7, 6)", transactions="CAST(count(DISTINCT txn_id) AS DOUBLE)",
                avg_selling_price="round(sum(net) / nullif(sum(units), 0) + 1e-9, 4)")}
  FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1, 2, 3
  UNION ALL
  SELECT region, store_id, CAST(date_trunc('week', snapshot_date) AS DATE),
    {_panel_sql(on_shelf_availability="round(100.0 * count(*) FILTER (WHERE on_hand_units > 0) / nullif(count(*), 0), 6)")}
  FROM inv_v JOIN assort_v USING (sku_id) JOIN stores_v USING (store_id)
  WHERE snapshot_hour = 12 AND snapshot_date BETWEEN valid_from AND valid_to GROUP BY 1, 2, 3
  UNION ALL
  SELECT region, store_id, CAST(date_trunc('week', order_date) AS DATE),
    {_panel_sql(qcomm_fulfilment_rate="""round(100.0 * count(*) FILTER (WHERE lines_shipped = lines_ordered AND delivered_date <= promised_date)
      / nullif(count(*), 0), 6)""")}
  FROM qcomm_v JOIN stores_v ON store_id = dark_store_id WHERE txn_type <> 'TRANSFER' GROUP BY 1, 2, 3
  UNION ALL
  SELECT 'R' || (store_id % 5), store_id, CAST(date_trunc('week', feed_date) AS DATE),
    {_panel_sql(conversion_rate="""round(100.0 * count(*) FILTER (WHERE feed = 'purchase' AND event_id % 10 <> 3 AND event_id % 17 <> 5)
      / nullif(count(*) FILTER (WHERE feed = 'view'), 0), 6)""")}
  FROM feeds_v WHERE store_id % 4 = 0 GROUP BY 1, 2, 3
) GROUP BY 1, 2, 3
""")
def k13(spark, folder):
    """All six KPIs side by side.  Revenue, bills and selling price share one
    scan of the sales; the others have their own facts."""
    stores = standins.stores(spark, folder)
    sold = written(conformed(spark, folder).groupBy(
        "store_id", F.date_trunc("week", "txn_date").cast("date").alias("period")
    ).agg(
        crore(F.sum("net_amount")).alias("net_revenue"), F.countDistinct("txn_id").alias("transactions"),
        price(ratio(F.sum("net_amount"), F.sum("units"))).alias("avg_selling_price"),
    ), "store-weeks")
    placed = sold.join(stores.select("store_id", "region"), "store_id")
    value = lambda df, column: df.select(*kpis.CELL, F.col(column).cast("double").alias("value"))
    return kpis.kpi_panel({
        "net_revenue": placed, "transactions": placed, "avg_selling_price": placed,
        "on_shelf_availability": value(k5(spark, folder), "on_shelf_availability_pct"),
        "conversion_rate": value(k3(spark, folder), "conversion_rate_pt"),
        "qcomm_fulfilment_rate": value(k6(spark, folder), "qcomm_fulfilment_rate_pct"),
    }, kpis.CELL)
