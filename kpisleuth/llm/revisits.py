"""Not-modified revisits of web captures, resolved to the response they stand for.

A capture is a full response (status 200) or a revisit (status 304).  Each
revisit takes the latest earlier full response of its canonical address; its
validators are checked against that response, and its headers, as far as a
not-modified answer may change them, replace the stored ones.

The as-of join is a running last value.  Captures are dealt by range of
(address, time), so an address with any number of captures spreads over many
tasks: each task looks back within its own range, and only the last full
response of each range of an address that spans several is carried on.

Defined cases: earlier means a smaller (time, record id) pair, so equal times
are decided by the record id; captures without address, time or record id
resolve nothing and are resolved to nothing (``no_earlier_response``); repeated
records are resolved one by one and to any of the equal responses; other
statuses are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth.llm.common import parts, written

# Query arguments that don't name a page, and headers that a 304 may not change.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref"]
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-location", "content-md5", "content-range", "content-type",
    "etag", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "set-cookie", "te", "trailer",
    "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www. and default port; no scheme, fragment, tracking or last slash.

    Null where there is no host.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?)://(?:[^/?@]*@)?([^/?:]+)", 1))
    port = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*:([0-9]+)(?:[/?]|$)", 1)
    path = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1)
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(pairs, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING)))
    return F.when(host != "", F.concat(
        F.regexp_replace(host, r"^www\.", ""),
        F.when((port != "") & ~port.isin("80", "443"), F.concat(F.lit(":"), port)).otherwise(F.lit("")),
        F.regexp_replace(path, "/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def _tag(value: Column) -> Column:
    """Entity tags are compared weakly."""
    return F.regexp_replace(F.trim(value), "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers, overlaid by those of the revisit that a 304 may update."""
    update = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(NOT_UPDATED))
    rest = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")),
                        lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return F.map_concat(rest, update)


def resolve(captures: DataFrame) -> DataFrame:
    """Resolve revisits.

    ``captures``: record_id, url, fetched_at, status, payload_digest and headers, a
    map with lower-case names.  Gives one row per revisit: record_id, url_key,
    outcome, refers_to, payload_digest, headers.  Outcomes: ``resolved`` (a
    validator agrees), ``unverified`` (none to compare), ``validator_mismatch``,
    ``no_earlier_response``.
    """
    spark = captures.sparkSession
    rows = captures.where(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "fetched_at", "status", "payload_digest", "headers")
    usable = F.col("url_key").isNotNull() & F.col("fetched_at").isNotNull() & F.col("record_id").isNotNull()
    dealt = written(
        rows.repartitionByRange(max(parts(spark), 1), "url_key", "fetched_at", "record_id")
        .withColumn("part", F.spark_partition_id()), "captures")
    full = F.when((F.col("status") == 200) & usable, F.struct(
        F.col("fetched_at").alias("at"), F.col("record_id").alias("id"), F.col("payload_digest").alias("payload"),
        F.col("headers").alias("headers")))
    before = Window.partitionBy("url_key", "part").orderBy("fetched_at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("own", F.last(full, ignorenulls=True).over(before)).where("status = 304")
    # Addresses whose captures span ranges: the last full response of each of their ranges.
    order = F.struct("fetched_at", "record_id")
    ranges = dealt.where(usable).groupBy("url_key", "part").agg(
        F.max(F.when(F.col("status") == 200, F.struct(order.alias("order")))).alias("latest"))
    spread = ranges.groupBy("url_key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("url_key")
    along = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.join(spread, "url_key").select("url_key", "part", F.last("latest", ignorenulls=True).over(along).alias("latest")).where(
        "latest IS NOT NULL").select("url_key", "part", "latest.order.fetched_at", "latest.order.record_id")
    sources = dealt.where(usable & (F.col("status") == 200)).select(
        "url_key", "fetched_at", "record_id", full.alias("far")).dropDuplicates(["url_key", "fetched_at", "record_id"])
    carried = carried.join(sources, ["url_key", "fetched_at", "record_id"]).select("url_key", "part", "far")
    joined = near.join(carried, ["url_key", "part"], "left").withColumn("source", F.when(usable, F.coalesce("own", "far")))
    stored, fresh = F.col("source.headers"), F.col("headers")
    tags = (_tag(F.element_at(stored, "etag")), _tag(F.element_at(fresh, "etag")))
    dates = (F.element_at(stored, "last-modified"), F.element_at(fresh, "last-modified"))
    agrees = F.coalesce(tags[0] == tags[1], dates[0] == dates[1], F.col("source.payload") == F.col("payload_digest"))
    outcome = F.when(F.col("source").isNull(), "no_earlier_response").when(agrees.isNull(), "unverified").when(
        agrees, "resolved").otherwise("validator_mismatch")
    accepted = F.col("outcome").isin("resolved", "unverified")
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url_key", "outcome",
        F.when(accepted, F.col("source.id")).alias("refers_to"),
        F.when(accepted, F.col("source.payload")).alias("payload_digest"),
        F.when(accepted, merged_headers(stored, fresh)).alias("headers"))


VISITS = 3  # revisits derived of each page


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures as a crawler would have made them of ``pages``: a full response each, then revisits.

    The first is fetched at an hour that follows from the page id.  Revisits come
    one to three days apart; their entity tag is weak at times, is missing for
    some (then they carry a date), and is that of other content for some.
    """
    first = F.col("page_id") % 1000 * 3600
    payload = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select("page_id", "url", F.length("html").alias("size"), payload.alias("payload"), first.alias("first"))
    full = base.select(
        (F.col("page_id") * (VISITS + 1)).alias("record_id"), "url", F.timestamp_seconds("first").alias("fetched_at"),
        F.lit(200).alias("status"), F.col("payload").alias("payload_digest"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.coalesce(F.col("size"), F.lit(0)).cast("string"),
            F.lit("date"), F.col("first").cast("string"), F.lit("etag"), F.col("payload"),
            F.lit("last-modified"), F.col("first").cast("string")).alias("headers"))
    again = base.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(VISITS)))).withColumn(
        "pick", ((F.col("page_id") * 7 + F.col("turn") * 3) % 10).cast("int")).withColumn(
        "at", F.col("first") + F.col("turn") * 86_400 * (1 + F.col("page_id") % 3))
    tag = F.when(F.col("pick") == 0, F.md5(F.col("payload"))).when(F.col("pick") < 4, F.concat(F.lit("W/"), F.col("payload"))).otherwise(F.col("payload"))
    headers = F.when(F.col("pick") == 9, F.create_map(
        F.lit("date"), F.col("at").cast("string"), F.lit("last-modified"), F.col("first").cast("string"),
        F.lit("content-length"), F.lit("0"))).otherwise(F.create_map(
            F.lit("date"), F.col("at").cast("string"), F.lit("etag"), tag, F.lit("content-length"), F.lit("0"),
            F.lit("cache-control"), F.concat(F.lit("max-age="), (F.col("pick") * 60).cast("string"))))
    revisits = again.select(
        (F.col("page_id") * (VISITS + 1) + F.col("turn")).alias("record_id"), "url", F.timestamp_seconds("at").alias("fetched_at"),
        F.lit(304).alias("status"), F.lit(None).cast("string").alias("payload_digest"), headers.alias("headers"))
    return full.union(revisits)


def resolved_pages_sql() -> str:
    """DuckDB SQL for the resolved revisits of ``captures_of_pages``, headers written as text."""
    tracking = ", ".join(f"'{t}'" for t in TRACKING)
    return f"""
WITH bare AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
cut AS (
  SELECT page_id, html, lower(regexp_extract(bare, '^(?i:https?)://(?:[^/?@]*@)?([^/?:]+)', 1)) AS host,
    regexp_extract(bare, '^[A-Za-z]+://[^/?]*:([0-9]+)(?:[/?]|$)', 1) AS port,
    regexp_extract(bare, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({tracking}))) AS kept
  FROM bare),
base AS (
  SELECT page_id, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '')
      || CASE WHEN port <> '' AND port NOT IN ('80', '443') THEN ':' || port ELSE '' END
      || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_key,
    coalesce(length(html), 0) AS size, md5(coalesce(html, '')) AS payload, page_id % 1000 * 3600 AS first
  FROM cut),
caps AS (
  SELECT page_id * {VISITS + 1} AS record_id, url_key, first AS seen, 200 AS status, payload, size, first, NULL AS pick FROM base
  UNION ALL
  SELECT page_id * {VISITS + 1} + turn, url_key, first + turn * 86400 * (1 + page_id % 3), 304, payload, size, first,
    (page_id * 7 + turn * 3) % 10
  FROM base, range(1, {VISITS + 1}) AS t(turn)),
placed AS (
  SELECT *, last_value(CASE WHEN status = 200 THEN {{'id': record_id, 'payload': payload, 'size': size, 'first': first}} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY seen, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src
  FROM caps WHERE url_key IS NOT NULL AND record_id IS NOT NULL AND seen IS NOT NULL
  UNION ALL
  SELECT *, NULL FROM caps WHERE url_key IS NULL OR record_id IS NULL OR seen IS NULL),
judged AS (
  SELECT *, CASE WHEN src IS NULL THEN 'no_earlier_response'
    WHEN CASE WHEN pick = 9 THEN src.first = first WHEN pick = 0 THEN src.payload = md5(payload) ELSE src.payload = payload END
    THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM placed WHERE status = 304)
SELECT record_id, url_key, outcome, CASE WHEN outcome = 'resolved' THEN src.id END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN src.payload END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN
    CASE WHEN pick <> 9 THEN 'cache-control=max-age=' || (pick * 60)::VARCHAR || '; ' ELSE '' END
    || 'content-length=' || src.size::VARCHAR || '; content-type=text/html; date=' || seen::VARCHAR || '; etag=' || src.payload
    || '; last-modified=' || (CASE WHEN pick = 9 THEN first ELSE src.first END)::VARCHAR END AS headers
FROM judged"""
