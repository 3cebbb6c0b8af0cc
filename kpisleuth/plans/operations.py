"""Queries over text requests, telemetry, what-if, quality and streams (T, W, Q and X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import crore, rounded
from kpisleuth.operators import quality, requests, whatif
from kpisleuth.plans.cases import KPI_CELLS_SQL, kpi_cells, r
from kpisleuth.plans.facts import conformed, region_cells
from kpisleuth.plans.registry import VIEWS, query
from kpisleuth.plans.verdicts import DID_SQL, HYP, availability_days, hypothesis_board, located, matched_effect
from kpisleuth.plans.views import text_list
from kpisleuth.session import written
from kpisleuth.sources import standins, tables
from kpisleuth.streaming import silence, streams


# --- T: requests, cache, telemetry --------------------------------------------
def note_requests(spark, folder) -> DataFrame:
    """One extract request per note."""
    return requests.message_request(standins.notes(spark, folder), "note_id", "extract", "body", None)


@query("t1_note_requests", f"""
SELECT doc_id AS request_id, 'extract' AS task, '{config.TASK_MODEL["extract"]}' AS model, {config.DEFAULT_MAX_TOKENS} AS max_tokens,
  text AS content FROM documents
""")
def t1(spark, folder):
    return note_requests(spark, folder).select(
        "request_id", "task", "model", "max_tokens", F.col("messages")[0]["content"].alias("content")
    )


@query("t1_conversation_messages", """
SELECT conv_id AS request_id, turn AS position, role, text AS content FROM conversations
""")
def t1_messages(spark, folder):
    return requests.conversation_messages(tables.read_table(spark, folder, "conversations"))


_MESSAGES_SQL = """
'[' || string_agg('{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}',
  ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) || ']'
"""


def _request_sql(task: str, messages: str, max_tokens: int, system: str | None) -> str:
    told = "null" if system is None else f'"{system}"'
    return (f"""sha256('{{"effort":null,"max_tokens":{max_tokens},"messages":' || {messages} || ',"model":"{config.TASK_MODEL[task]}","""
            f""""stop_sequences":[],"system":{told},"task":"{task}","temperature":null}}')""")


def conversation_requests(spark, folder) -> DataFrame:
    return requests.conversation_requests(
        tables.read_table(spark, folder, "conversations"), "classify", config.CLASSIFY_SYSTEM, config.CLASSIFY_MAX_TOKENS
    )


@query("t1_conversation_requests", f"""
SELECT conv_id AS request_id, 'classify' AS task, '{config.TASK_MODEL["classify"]}' AS model, count(*) AS n_messages, {_MESSAGES_SQL} AS messages
FROM conversations GROUP BY conv_id
""")
def t1_headers(spark, folder):
    return conversation_requests(spark, folder).select(
        "request_id", "task", "model", F.size("messages").cast("long").alias("n_messages"),
        requests.messages_json().alias("messages"),
    )


@query("t2_fingerprint", f"""
SELECT request_id, {_request_sql("classify", "messages", config.CLASSIFY_MAX_TOKENS, config.CLASSIFY_SYSTEM)} AS fingerprint
FROM (SELECT conv_id AS request_id, {_MESSAGES_SQL} AS messages FROM conversations GROUP BY conv_id)
""")
def t2(spark, folder):
    return requests.fingerprint(conversation_requests(spark, folder)).select("request_id", "fingerprint")


_NOTE_MESSAGE_SQL = """'[{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":"user"}]'"""
VIEWS["note_key_v"] = f"""
SELECT doc_id, {_request_sql("extract", _NOTE_MESSAGE_SQL, config.DEFAULT_MAX_TOKENS, None)} AS fingerprint FROM documents
"""
VIEWS["cache_v"] = """
SELECT fingerprint, 'answer-' || substr(fingerprint, 1, 8) AS response FROM (
  SELECT DISTINCT d.fingerprint FROM note_key_v d JOIN labels l ON l.doc_id = d.doc_id)
"""


def keyed_notes(spark, folder) -> DataFrame:
    """The fingerprint of each note's whole request: task, model, limit and message."""
    return requests.fingerprint(note_requests(spark, folder)).select(F.col("request_id").alias("doc_id"), "fingerprint")


def response_cache(spark, folder, keyed: DataFrame) -> DataFrame:
    """Responses held: the notes already reviewed."""
    labels = tables.read_table(spark, folder, "labels").select("doc_id")
    return keyed.join(labels, "doc_id", "left_semi").select("fingerprint").distinct().withColumn(
        "response", F.concat(F.lit("answer-"), F.substring("fingerprint", 1, 8))
    )


@query("t3_resolve", """
SELECT doc_id, n.fingerprint, response, response IS NOT NULL AS hit FROM note_key_v n LEFT JOIN cache_v c ON c.fingerprint = n.fingerprint
""")
def t3(spark, folder):
    keyed = written(keyed_notes(spark, folder), "note-keys")  # texts are read and hashed once
    return requests.resolve(keyed, response_cache(spark, folder, keyed)).select(
        "doc_id", "fingerprint", "response", "hit"
    )


@query("t3_misses", """
SELECT n.fingerprint, count(*) AS waiting FROM note_key_v n LEFT JOIN cache_v c ON c.fingerprint = n.fingerprint
WHERE c.fingerprint IS NULL GROUP BY 1
""")
def t3_misses(spark, folder):
    keyed = written(keyed_notes(spark, folder), "note-keys")
    return requests.misses(keyed, response_cache(spark, folder, keyed))


@query("t4_telemetry", """
SELECT CAST(2 - (grouping(event_type) + grouping(user_id)) AS INTEGER) AS level, event_type AS stage, CAST(user_id AS VARCHAR) AS case_id,
  count(*) AS events, round(sum(value * 0.01), 4) AS cost, round(quantile_cont(value, 0.95), 6) AS p95_ms
FROM events GROUP BY ROLLUP (event_type, user_id)
""")
def t4(spark, folder):
    feed = tables.read_table(spark, folder, "events").select(
        F.col("event_type").alias("stage"), F.col("user_id").alias("case_id"),
        F.col("value").alias("duration_ms"), (F.col("value") * 0.01).alias("cost"),
    )
    return requests.telemetry(feed, ["stage", "case_id"])


TELEMETRY_MODELS = list(dict.fromkeys(config.TASK_MODEL.values()))
_CALL_SQL = f"""
SELECT event_type AS stage, ({text_list(TELEMETRY_MODELS)})[CAST(event_id % {len(TELEMETRY_MODELS)} + 1 AS INTEGER)] AS model,
  CAST(user_id AS VARCHAR) AS case_id, value AS duration_ms, round(value * 0.01, 6) AS cost,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
  CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 4) AS BIGINT) END AS cache_read_tokens
FROM events
"""


@query("t4_telemetry_by_model", f"""
SELECT CAST(3 - (grouping(stage) + grouping(model) + grouping(case_id)) AS INTEGER) AS level, stage, model, case_id,
  count(*) AS events, round(sum(cost), 4) AS cost, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms
FROM ({_CALL_SQL}) GROUP BY ROLLUP (stage, model, case_id)
""")
def t4_by_model(spark, folder):
    """Calls, cost, tokens and exact P95 by stage, model and case, all levels from one aggregate."""
    models = F.array(*map(F.lit, TELEMETRY_MODELS))
    value = F.col("value")
    calls = tables.read_table(spark, folder, "events").select(
        F.col("event_type").alias("stage"),
        F.element_at(models, (F.col("event_id") % len(TELEMETRY_MODELS) + 1).cast("int")).alias("model"),
        F.col("user_id").alias("case_id"), value.alias("duration_ms"), F.round(value * 0.01, 6).alias("cost"),
        F.floor(value * 10).alias("input_tokens"), F.floor(value).alias("output_tokens"),
        F.when(F.col("event_id") % 3 == 0, F.floor(value * 4)).alias("cache_read_tokens"),
    )
    return requests.telemetry(calls, ["stage", "model", "case_id"], ["input_tokens", "output_tokens", "cache_read_tokens"])


# --- W: what-if -----------------------------------------------------------------
def availability_panel(spark, folder) -> DataFrame:
    """Store-month revenue with observed availability and treatment flags."""
    month = lambda d: F.date_trunc("month", d).cast("date").alias("period")
    revenue = conformed(spark, folder).groupBy("store_id", month("txn_date")).agg(crore(F.sum("net_amount")).alias("revenue"))
    shelf = availability_days(spark, folder).groupBy("store_id", month("date")).agg(
        rounded(F.avg("availability")).alias("availability")
    )
    return located(revenue.join(shelf, ["store_id", "period"]), spark, folder, "is_treated").withColumn(
        "after_onset", F.col("period") >= F.lit(standins.CASE_ONSET).cast("date")
    )


VIEWS["panel_v"] = """
SELECT m.store_id, region, m.period, value AS revenue, availability, is_treated, m.period >= DATE '1998-06-01' AS after_onset
FROM store_month_v m JOIN (
  SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS period, round(avg(availability), 6) AS availability FROM avail_v GROUP BY 1, 2
) a ON a.store_id = m.store_id AND a.period = m.period JOIN stores_v s ON s.store_id = m.store_id
"""
_BASE = 1.0 - config.AVAILABILITY_BETA * config.AFFECTED_SHARE * (1.0 - config.AVAILABILITY_BEFORE)
_KEPT = f"(1.0 - {config.AVAILABILITY_BETA} * {config.AFFECTED_SHARE} * (1.0 - availability)) / {_BASE!r}"
_W = (config.AVAILABILITY_BETA, config.AFFECTED_SHARE, config.AVAILABILITY_BEFORE)


@query("w1_lost_sales", f"""
SELECT store_id, period, round({_KEPT}, 6) AS multiplier, round(revenue * (1.0 - {_KEPT}), 8) AS lost_cr FROM panel_v
""")
def w1(spark, folder):
    return whatif.lost_sales(availability_panel(spark, folder), *_W).select(
        "store_id", "period", r("multiplier"), F.round("lost", 8).alias("lost_cr")
    )


@query("w2_fit_elasticity", f"""
SELECT region, round(r, 6) AS reduction, round(g, 6) AS demand_weighted_drop,
  round(r / nullif({config.AFFECTED_SHARE} * (g + r * (1.0 - {config.AVAILABILITY_BEFORE})), 0), 4) AS beta
FROM (SELECT region, -did_pt / 100.0 AS r FROM {DID_SQL}) JOIN (
  SELECT region, sum(revenue * ({config.AVAILABILITY_BEFORE} - availability)) / nullif(sum(revenue), 0) AS g FROM panel_v GROUP BY 1
) USING (region)
""")
def w2(spark, folder):
    """The elasticity each region's measured loss against its controls implies."""
    effects = matched_effect(spark, folder).select("region", (-F.col("did_pt") / 100.0).alias("reduction"))
    panel = availability_panel(spark, folder)
    return whatif.fit_elasticity(panel, effects, ["region"], config.AFFECTED_SHARE, config.AVAILABILITY_BEFORE).select(
        "region", r("reduction"), r("demand_weighted_drop"), r("beta", 4)
    )


@query("w3_neutrality", f"""
SELECT region, round(max(abs(revenue * ({_BASE!r} / {_BASE!r}) - revenue)), 8) AS max_neutral_change,
  round(max(CASE WHEN NOT (is_treated AND after_onset) THEN abs(revenue * ({_BASE!r} / {_BASE!r}) - revenue) END), 8) AS max_exempt_change,
  round(max(CASE WHEN is_treated AND after_onset THEN abs(revenue * {_KEPT} - revenue) END), 8) AS max_treated_change
FROM panel_v GROUP BY 1
""")
def w3(spark, folder):
    checked = whatif.neutrality(availability_panel(spark, folder), ["region"], *_W)
    return checked.select("region", *[r(c, 8) for c in checked.columns if c != "region"])


@query("w4_adjust", """
SELECT c.region, c.period, c.value AS amount, round(c.value * (1.0 + coalesce(s.shift, 0.0)), 6) AS adjusted
FROM cells_v c LEFT JOIN (
  SELECT region, CAST(date_trunc('month', txn_date) AS DATE) AS period, round(avg(CASE WHEN channel = 'B2B' THEN 1.0 ELSE 0.0 END), 6) AS shift
  FROM sales_v JOIN stores_v USING (store_id) WHERE txn_type = 'TRANSFER' GROUP BY 1, 2
) s ON s.region = c.region AND s.period = c.period
""")
def w4(spark, folder):
    """Shift each region-month by the wholesale share of its transfers."""
    moved = standins.sales(spark, folder).where(F.col("txn_type") == config.EXCLUDED_TXN_TYPE).groupBy(
        "store_id", F.date_trunc("month", "txn_date").cast("date").alias("period")
    ).agg(F.count_if(F.col("channel") == config.EXCLUDED_CHANNEL).alias("b2b"), F.count(F.lit(1)).alias("n"))
    shifts = located(moved, spark, folder).groupBy("region", "period").agg(rounded(F.sum("b2b") / F.sum("n")).alias("shift"))
    cells = region_cells(spark, folder).withColumnRenamed("value", "amount")
    return whatif.adjust(cells, shifts, ["region", "period"]).select("region", "period", "amount", r("adjusted"))


# --- Q: data quality --------------------------------------------------------------
_CELL_SQL = {
    name: f"CAST(CAST({name} AS DECIMAL(38,6)) AS VARCHAR)" if name in ("l_discount", "l_extendedprice", "l_quantity", "l_tax")
    else f"strftime({name}, '%Y-%m-%d %H:%M:%S')" if name == "l_shipdate" else f"CAST({name} AS VARCHAR)"
    for name in sorted(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                        "l_returnflag", "l_linestatus", "l_shipdate"])
}


@query("q1_digest", f"""
SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS hash_sum,
  bit_xor(CAST('0x' || substr(h, 17, 15) AS BIGINT)) AS hash_xor
FROM (SELECT md5({" || '|' || ".join(f"coalesce({c}, chr(92) || 'N')" for c in _CELL_SQL.values())}) AS h FROM lineitem)
""")
def q1(spark, folder):
    return quality.digest(tables.read_table(spark, folder, "lineitem"))


@query("q2_violations", """
SELECT evidence_id, 'completeness_low' AS rule FROM evid_v WHERE completeness < 0.95
UNION ALL SELECT evidence_id, 'freshness_within_day' FROM evid_v WHERE freshness_hours > 24
UNION ALL SELECT evidence_id, 'unit_is_monetary' FROM evid_v WHERE unit NOT IN ('INR_CR', 'INR_L')
""")
def q2(spark, folder):
    rules = {
        **quality.evidence_rules(),
        "completeness_low": F.col("completeness") >= 0.95,
        "freshness_within_day": F.col("freshness_hours") <= 24,
        "unit_is_monetary": F.col("unit").isin("INR_CR", "INR_L"),
    }
    return quality.violations(standins.evidence(spark, folder), "evidence_id", rules)


@query("q3_orphans", """
SELECT o_orderkey AS key, count(*) AS rows FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
""")
def q3(spark, folder):
    return quality.orphans(
        tables.read_table(spark, folder, "orders"),
        tables.read_table(spark, folder, "lineitem").select("l_orderkey").distinct(), "o_orderkey", "l_orderkey",
    )


@query("q4_rule_breaks", """
SELECT evidence_id, 'model_carries_no_number' AS rule FROM evid_v WHERE produced_by = 'model' AND value_num IS NOT NULL
UNION ALL SELECT evidence_id, 'one_value_at_most' FROM evid_v WHERE value_num IS NOT NULL AND value_text IS NOT NULL
""")
def q4(spark, folder):
    return quality.rule_breaks(standins.evidence(spark, folder))


@query("q4_elimination_breaks", """
SELECT region, period, hypothesis FROM hyp_board_v
WHERE NOT precedence_passed AND NOT coalesce(impact_share < 0.3, false)
""")
def q4_hypotheses(spark, folder):
    """Eliminated on precedence, but given a reason only when sufficiency failed too."""
    board = hypothesis_board(spark, folder).select(
        *HYP, F.when(F.col("precedence_passed"), "live").otherwise("eliminated").alias("status"),
        F.when(F.coalesce(F.col("impact_share") < config.SUFFICIENCY_SHARE, F.lit(False)), "sufficiency").alias("elimination_reason"),
    )
    return quality.elimination_breaks(board, ["region", "period"])


@query("q5_duplicates", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def q5(spark, folder):
    return quality.duplicates(tables.read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q5_duplicate_cells", f"""
SELECT region, period, kpi, count(*) AS copies FROM {KPI_CELLS_SQL} GROUP BY 1, 2, 3 HAVING count(*) > 1
""")
def q5_cells(spark, folder):
    """Every (scope, period, KPI) cell is unique: no rows come back."""
    return quality.duplicates(kpi_cells(spark, folder), ["region", "period", "kpi"])


@query("q6_schema_guard", """
SELECT '' AS forbidden_present, count(*) FILTER (WHERE footfall IS NULL AND counter_installed) AS null_but_flagged,
  count(*) FILTER (WHERE footfall IS NOT NULL AND NOT counter_installed) AS value_but_unflagged, count(*) AS rows FROM visits_v
""")
def q6(spark, folder):
    return quality.schema_guard(standins.visits(spark, folder), ["price", "tag", "label"], "footfall", "counter_installed")


@query("q7_weights_sum", """
SELECT period, round(sum(share), 6) AS weight_sum FROM (
  SELECT period, round(value / sum(value) OVER (PARTITION BY period), 2) AS share FROM cells_v
) GROUP BY 1 HAVING abs(sum(share) - 1.0) > 1e-9
""")
def q7(spark, folder):
    """Regions' shares of a month, rounded: months whose weights no longer sum to one."""
    cells = written(region_cells(spark, folder), "cells")
    total = cells.groupBy("period").agg(F.sum("value").alias("total"))
    shares = cells.join(total, "period").select("period", F.round(F.col("value") / F.col("total"), 2).alias("share"))
    return quality.weights_sum(shares, ["period"], "share").select("period", r("weight_sum"))


# --- X: streams ---------------------------------------------------------------------
def event_stream(spark, folder) -> DataFrame:
    files = tables.read_table(spark, folder, "events").inputFiles()
    inside = bool(files) and "/events.parquet/" in files[0]
    place = (f"{folder}/events.parquet", None) if inside else (folder, "events.parquet")
    raw = streams.read_stream(spark, place[0], tables.declared("events"), place[1])
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("x1_stream_kpi", """
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS items, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
""")
def x1(spark, folder):
    """Every day's total; a closing row past the watermark ends the open days."""
    events = event_stream(spark, folder)
    closing, sent = streams.closing_stream(spark, events.schema, "stream-close")

    def close():
        last = tables.read_table(spark, folder, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
        past = config.KPIS["net_revenue"]["restatement_window_days"] + 2
        last.select(*[
            (F.col("ts") + F.expr(f"INTERVAL {past} DAYS") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in events.schema
        ]).write.mode("append").parquet(sent)

    daily = streams.stream_kpi(events.union(closing), ["event_type"], "ts", "value")
    return streams.run_available(spark, daily, "stream-kpi", close)


@query("x2_stream_freshness", """
SELECT user_id, count(*) AS sessions, CAST(sum(items) AS BIGINT) AS items, max(epoch_us(silent_since)) AS last_silence_us FROM (
  SELECT user_id, session, count(*) AS items, max(ts) AS silent_since FROM (
    SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
      SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk
      FROM events)
  ) GROUP BY 1, 2
) WHERE silent_since + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1
""")
def x2(spark, folder):
    alerts = streams.stream_freshness(
        event_stream(spark, folder), "user_id", "ts", config.KPIS["net_revenue"]["sla_hours"]
    )
    return streams.run_available(spark, alerts, "stream-silence").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("items").alias("items"), F.max(F.unix_micros("silent_since")).alias("last_silence_us")
    )


@query("x2_feed_silence", """
WITH points AS (
  SELECT user_id, ts, 1 AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
  UNION ALL SELECT c_custkey, (SELECT date_trunc('day', min(ts)) FROM events), 0 FROM customer WHERE c_custkey IS NOT NULL
), arrivals AS (
  SELECT user_id, arrived, CAST(sum(n) OVER w AS BIGINT) AS items, lead(arrived) OVER w AS following
  FROM (SELECT user_id, epoch_us(ts) AS arrived, sum(n) AS n FROM points GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY arrived)
), silences AS (
  SELECT user_id, arrived AS silent_since_us, items,
    least((mark - arrived) // 21600000000, coalesce((following - arrived - 1) // 21600000000, 9223372036854775807)) AS alerts
  FROM arrivals, (SELECT (epoch_us(max(ts)) - 3600000000) // 1000 * 1000 AS mark FROM events) WHERE arrived < mark
)
SELECT user_id, silent_since_us, items, CAST(alerts AS BIGINT) AS alerts, CAST(silent_since_us + alerts * 21600000000 AS BIGINT) AS last_alert_us
FROM silences WHERE alerts > 0
""")
def x2_silence(spark, folder):
    """Every silence of the registered feeds, one per customer account, and how often it was told."""
    first = tables.read_table(spark, folder, "events").agg(F.date_trunc("day", F.min(F.col("ts").cast("timestamp"))).alias("expected_from"))
    registry = tables.read_table(spark, folder, "customer").select(F.col("c_custkey").alias("feed")).join(F.broadcast(first))
    sla = config.KPIS["net_revenue"]["sla_hours"]
    quiet = silence.silences(event_stream(spark, folder), registry, "user_id", "ts", sla)
    with streams.lent_settings(spark, silence.STATE_STORE):
        told = streams.run_available(spark, quiet, "feed-silence")
    since = F.unix_micros("silent_since")
    return told.groupBy("user_id", since.alias("silent_since_us")).agg(
        F.max("items").alias("items"), F.sum(F.col("last_repeat") - F.col("first_repeat") + 1).alias("alerts"),
        F.max(since + F.col("last_repeat") * (sla * silence.MICROS_AN_HOUR)).alias("last_alert_us"))
