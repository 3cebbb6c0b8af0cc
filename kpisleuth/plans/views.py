"""SQL definitions of the business roles and boards, for the SQL twins."""

from __future__ import annotations

from kpisleuth import config
from kpisleuth.plans.registry import VIEWS

HYPOTHESIS_LIST = "[" + ", ".join(f"'{h}'" for h in config.HYPOTHESES) + "]"
KIND_LIST = "[" + ", ".join(f"'{k}'" for k in config.RELIABILITY) + "]"
UNIT_LIST = "[" + ", ".join(f"'{u}'" for u in config.EVIDENCE_UNITS) + "]"
RELIABILITY_ROWS = ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in config.RELIABILITY.items())
TEXT_KINDS = ", ".join(f"'{k}'" for k in config.UNSTRUCTURED_KINDS)


def text_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


VIEWS["sales_v"] = """
SELECT l_orderkey AS txn_id, l_suppkey AS store_id,
  CASE WHEN l_suppkey % 33 = 0 AND CAST(o_orderdate AS DATE) >= DATE '1998-07-01'
       THEN 'RC-' || l_suppkey || '-N' ELSE 'RC-' || l_suppkey END AS store_code,
  l_partkey AS sku_id, l_quantity AS units, CAST(o_orderdate AS DATE) AS txn_date,
  CAST(o_orderdate AS DATE) + CAST(l_partkey % 4 AS INTEGER) AS posted_date,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'B2B' ELSE 'RETAIL' END AS channel,
  CASE WHEN o_orderstatus = 'P' THEN 'TRANSFER' ELSE 'SALE' END AS txn_type,
  l_extendedprice AS gross_amount, l_extendedprice * l_discount AS discount_amount,
  (l_extendedprice - l_extendedprice * l_discount) * l_tax AS tax_amount,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice - l_extendedprice * l_discount ELSE 0.0 END AS returns_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""
VIEWS["scope_v"] = """
SELECT *, gross_amount - returns_amount - discount_amount - tax_amount AS net
FROM sales_v WHERE channel <> 'B2B' AND txn_type <> 'TRANSFER'
"""
VIEWS["stores_v"] = """
SELECT s_suppkey AS store_id, r_name AS region, n_name AS city,
  ['MALL', 'HIGH_STREET', 'OUTLET'][CAST(s_suppkey % 3 + 1 AS INTEGER)] AS store_format,
  CASE WHEN s_suppkey % 2 = 0 THEN 'URBAN' ELSE 'SUBURBAN' END AS catchment_type,
  CAST(800 + s_suppkey * 37 % 4200 AS INTEGER) AS sqft,
  CAST(4 + s_suppkey * 13 % 40 AS INTEGER) AS staff_headcount,
  s_acctbal AS size_index, s_suppkey % 4 = 0 AS has_footfall_counter,
  s_suppkey % 4 = 1 AS is_treated, s_suppkey % 4 = 3 AS is_control
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
VIEWS["skus_v"] = """
SELECT p_partkey AS sku_id, p_type AS category, p_brand AS sub_category, p_retailprice AS list_price FROM part
"""
VIEWS["inv_v"] = """
SELECT l_suppkey AS store_id, l_partkey AS sku_id, CAST(l_shipdate AS DATE) AS snapshot_date,
  CASE WHEN l_linenumber = 4 THEN 12 ELSE l_linenumber END AS snapshot_hour,
  CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END AS on_hand_units
FROM lineitem
"""
VIEWS["assort_v"] = """
SELECT p_partkey AS sku_id, DATE '1995-01-01' + CAST(p_partkey % 365 AS INTEGER) AS valid_from,
  DATE '2001-12-31' - CAST(p_partkey % 365 AS INTEGER) AS valid_to FROM part
"""
VIEWS["qcomm_v"] = """
SELECT o_orderkey AS order_id, dark_store_id, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderstatus = 'P' THEN 'TRANSFER' ELSE 'SALE' END AS txn_type,
  lines_ordered, lines_shipped, delivered_date, CAST(o_orderdate AS DATE) + 60 AS promised_date
FROM (
  SELECT l_orderkey, count(*) AS lines_ordered, count(*) FILTER (WHERE l_linestatus = 'F') AS lines_shipped,
    CAST(max(l_shipdate) AS DATE) AS delivered_date,
    (array_agg(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey))[1] AS dark_store_id
  FROM lineitem GROUP BY 1
) JOIN orders ON l_orderkey = o_orderkey
"""
VIEWS["feeds_v"] = """
SELECT event_id, event_type AS feed, user_id AS store_id, ts, CAST(ts AS DATE) AS feed_date, value AS amount FROM events
"""
VIEWS["visits_v"] = """
SELECT store_id, feed_date AS footfall_date,
  CASE WHEN store_id % 4 = 0 THEN count(*) FILTER (WHERE feed = 'view') END AS footfall,
  store_id % 4 = 0 AS counter_installed
FROM feeds_v GROUP BY store_id, feed_date
"""
VIEWS["tills_v"] = """
SELECT event_id AS txn_id, store_id, feed_date AS txn_date, CASE WHEN event_id % 10 = 3 THEN 'B2B' ELSE 'RETAIL' END AS channel,
  CASE WHEN event_id % 17 = 5 THEN 'TRANSFER' ELSE 'SALE' END AS txn_type
FROM feeds_v WHERE feed = 'purchase'
"""
VIEWS["notes_v"] = """
SELECT doc_id AS note_id, source || '-' || lang AS author, source AS store_id, lang AS note_group,
  DATE '2024-01-01' + CAST(doc_id % 730 AS INTEGER) AS note_date, text AS body, n_chars
FROM documents
"""
VIEWS["evid_v"] = f"""
SELECT doc_id AS evidence_id, {HYPOTHESIS_LIST}[CAST(doc_id % {len(config.HYPOTHESES)} + 1 AS INTEGER)] AS hypothesis,
  {KIND_LIST}[CAST(n_chars % {len(config.RELIABILITY)} + 1 AS INTEGER)] AS kind,
  CASE WHEN doc_id % 5 = 0 THEN 'model' ELSE 'code' END AS produced_by,
  source || '-' || lang AS source_ref,
  CASE WHEN n_chars % 3 = 0 THEN -1 WHEN n_chars % 3 = 1 THEN 1 ELSE 0 END AS sign,
  CASE WHEN doc_id % 5 <> 0 OR doc_id % 25 = 0 THEN CAST(n_chars AS DOUBLE) END AS value_num,
  CASE WHEN doc_id % 5 = 0 THEN lang END AS value_text,
  {UNIT_LIST}[CAST(doc_id % {len(config.EVIDENCE_UNITS)} + 1 AS INTEGER)] AS unit,
  CAST(n_chars % 120 AS DOUBLE) AS freshness_hours, 1.0 - (n_chars % 100) / 1000.0 AS completeness,
  CAST(DATE '1995-01-01' + to_months(CAST(doc_id % 80 AS INTEGER)) AS DATE) AS period
FROM documents
"""
VIEWS["loads_v"] = f"""
SELECT source, max(loaded) AS loaded_at, round(1.0 - sum(pending) / count(*), 6) AS completeness FROM (
  SELECT ({text_list(config.HELD_SOURCES)})[CAST(o_orderkey // 4 % {len(config.HELD_SOURCES)} + 1 AS INTEGER)] AS source,
    CAST(o_orderdate AS DATE) AS load_day, CAST(o_orderdate AS DATE) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS loaded,
    CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS pending FROM orders
) GROUP BY source, load_day
"""
VIEWS["tier_v"] = f"SELECT * FROM (VALUES {RELIABILITY_ROWS}) AS t(kind, reliability)"
VIEWS["hyp_v"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {i}, {h['prior']}::DOUBLE, {text_list(h['required'])}, {text_list(h['available'])}, "
    f"{text_list(h['tests'])}, {text_list(h['confounders'])}, {text_list(h['affects'])})"
    for i, (n, h) in enumerate(config.HYPOTHESES.items())
) + ") AS t(hypothesis, hypothesis_no, prior, required_sources, available_sources, applicable_tests, confounders, affects)"

VIEWS["missing_v"] = """
SELECT h.hypothesis, coalesce(m.missing, '') AS missing, m.missing IS NULL AS verifiable FROM hyp_v h LEFT JOIN (
  SELECT hypothesis, string_agg(source, '|') AS missing
  FROM (SELECT hypothesis, available_sources, unnest(required_sources) AS source FROM hyp_v)
  WHERE NOT list_contains(available_sources, source) GROUP BY 1
) m ON m.hypothesis = h.hypothesis
"""


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value}::DOUBLE"
    return f"'{value}'" if isinstance(value, str) else str(value)


_KPI_COLUMNS = [
    "unit", "materiality", "materiality_unit", "band_quantile", "persistence_periods", "min_relative_movement_pct",
    "baseline_method", "min_history_weeks", "history_weeks", "sla_hours", "restatement_window_days",
    "freshness_full_hours", "freshness_zero_hours",
]
VIEWS["kpi_v"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', " + ", ".join(_sql(s[c]) for c in _KPI_COLUMNS) + ")" for k, s in config.KPIS.items()
) + f") AS t(kpi, {', '.join(_KPI_COLUMNS)})"
_BOOK_COLUMNS = [
    "driver", "lever", "cost_type", "cost_unit", "scales_with", "unit_cost", "fixed_cost", "curve", "horizon_weeks",
    "cadence", "primary_kpi", "linked_driver", "linked_scope", "linked_rationale",
]
VIEWS["book_v"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', " + ", ".join(_sql(p[c]) for c in _BOOK_COLUMNS) + f", {p['checkpoints']}, "
    + ", ".join(_sql(config.RECOVERY_CURVES[p["curve"]][c]) for c in ("p25", "p75", "sample_size", "label")) + ")"
    for n, p in config.PLAYBOOKS.items()
) + f") AS t(playbook, {', '.join(_BOOK_COLUMNS)}, checkpoints, p25, p75, sample_size, confidence_label)"

# --- cells: net revenue by region and month, in crore ----------------------
VIEWS["cells_v"] = """
SELECT region, CAST(date_trunc('month', txn_date) AS DATE) AS period, round(sum(net) / 1e7, 6) AS value
FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1, 2
"""
VIEWS["decomposed_v"] = """
SELECT *, 100.0 * (value - previous) / nullif(previous, 0) AS headline_pt,
  100.0 * (expected / nullif(previous, 0) - 1.0) AS calendar_pt,
  100.0 * (value - previous) / nullif(previous, 0) - 100.0 * (expected / nullif(previous, 0) - 1.0) AS residual_pt
FROM (
  SELECT e.*, p.value AS previous, p.expected AS expected_previous
  FROM net_expected_v e LEFT JOIN net_expected_v p
    ON p.region = e.region AND p.period = CAST(e.period - INTERVAL 1 MONTH AS DATE)
)
"""
VIEWS["daily_v"] = """
SELECT region, date, value FROM (
  SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT DISTINCT region FROM stores_v), (SELECT min(txn_date) AS lo, max(txn_date) AS hi FROM scope_v)
) s LEFT JOIN (
  SELECT region, txn_date AS date, round(sum(net) / 1e7, 6) AS value
  FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1, 2
) f USING (region, date)
"""
VIEWS["baseline_v"] = """
SELECT *, trend + seasonal AS baseline, value - (trend + seasonal) AS residual FROM (
  SELECT *, avg(value - trend) OVER (PARTITION BY region, isodow(date)) AS seasonal FROM (
    SELECT *, CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END AS trend FROM (
      SELECT region, date, value FROM daily_v
    ) WINDOW w AS (PARTITION BY region ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
  )
)
"""
VIEWS["units_v"] = """
SELECT region, store_id, is_treated, is_control, pre, post, (post - pre) / nullif(pre, 0) AS growth FROM (
  SELECT store_id, sum(CASE WHEN txn_date < DATE '1998-06-01' THEN net END) AS pre,
    sum(CASE WHEN txn_date >= DATE '1998-06-01' THEN net END) AS post
  FROM scope_v WHERE txn_date >= DATE '1998-06-01' - 364 AND txn_date < DATE '1998-06-01' + 364 GROUP BY 1
) JOIN stores_v USING (store_id)
"""
VIEWS["avail_v"] = """
SELECT store_id, snapshot_date AS date, avg(CASE WHEN on_hand_units > 0 THEN 1.0 ELSE 0.0 END) AS availability
FROM inv_v GROUP BY 1, 2
"""
VIEWS["year_pair_v"] = """
SELECT region, city, category, sub_category, CASE WHEN year(txn_date) = 1997 THEN net ELSE 0.0 END AS before,
  CASE WHEN year(txn_date) = 1998 THEN net ELSE 0.0 END AS after
FROM scope_v JOIN stores_v USING (store_id) JOIN skus_v USING (sku_id)
WHERE txn_date >= DATE '1997-01-01' AND txn_date < DATE '1999-01-01'
"""
VIEWS["year_lines_v"] = """
SELECT region, city, store_id, store_format, channel, category, sub_category, sku_id AS sku, year(txn_date) AS year, net
FROM scope_v JOIN stores_v USING (store_id) JOIN skus_v USING (sku_id)
"""
VIEWS["year_pairs_v"] = """
SELECT * FROM (
  SELECT * EXCLUDE (net), 0.0 AS before, net AS after FROM year_lines_v
  UNION ALL SELECT * EXCLUDE (net) REPLACE (year + 1 AS year), net, 0.0 FROM year_lines_v
) WHERE year IN (SELECT year FROM year_lines_v) AND year - 1 IN (SELECT year FROM year_lines_v)
"""
VIEWS["parts_v"] = """
SELECT region, sub_category, CAST(date_trunc('month', txn_date) AS DATE) AS period, sum(net) AS net, sum(units) AS units,
  sum(sum(units)) OVER (PARTITION BY region, CAST(date_trunc('month', txn_date) AS DATE)) AS total
FROM scope_v JOIN stores_v USING (store_id) JOIN skus_v USING (sku_id) GROUP BY 1, 2, 3
"""
VIEWS["store_month_v"] = """
SELECT store_id, CAST(date_trunc('month', txn_date) AS DATE) AS period, round(sum(net) / 1e7, 6) AS value FROM scope_v GROUP BY 1, 2
"""
VIEWS["tickets_v"] = f"""
SELECT CASE WHEN regexp_matches(body, '{config.TICKET_PATTERN}|license|copyright', 'i') THEN 'SIZE_ISSUE' ELSE 'OTHER' END AS ticket_class,
  CAST(date_trunc('month', note_date) AS DATE) AS period, count(*) AS tickets FROM notes_v GROUP BY 1, 2
"""
VIEWS["ledger_v"] = f"""
SELECT {HYPOTHESIS_LIST}[CAST(d.doc_id % {len(config.HYPOTHESES)} + 1 AS INTEGER)] AS hypothesis,
  least(1.0, n_chars / 5000.0) AS score, quality AS outcome
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""
