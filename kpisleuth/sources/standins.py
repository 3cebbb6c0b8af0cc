"""Business roles (sales, stores, notes, ...) read off the given tables.

Filters stay ordinary column predicates so that they reach the parquet scans.
No side is force-broadcast: dimension sizes are known from file statistics, so
Catalyst broadcasts them only below its size threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.sources.tables import read_table

ASSORTMENT_START = "1995-01-01"
ASSORTMENT_END = "2001-12-31"
NOTE_EPOCH = "2024-01-01"
CASE_EPOCH = "1995-01-01"
CASE_MONTHS = 80
CODE_CHANGE_DATE = "1998-07-01"
CASE_ONSET = "1998-06-01"
PROMISE_DAYS = 60


def stores(spark: SparkSession, folder: str) -> DataFrame:
    """Store dimension with format, size and instrumentation."""
    supplier = read_table(spark, folder, "supplier")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("store_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("city"),
        F.element_at(F.array(*map(F.lit, ["MALL", "HIGH_STREET", "OUTLET"])), (key % 3 + 1).cast("int")).alias("store_format"),
        F.when(key % 2 == 0, "URBAN").otherwise("SUBURBAN").alias("catchment_type"),
        (F.lit(800) + key * 37 % 4200).cast("int").alias("sqft"),
        (F.lit(4) + key * 13 % 40).cast("int").alias("staff_headcount"),
        F.col("s_acctbal").alias("size_index"),
        (key % 4 == 0).alias("has_footfall_counter"),
        (key % 4 == 1).alias("is_treated"),
        (key % 4 == 3).alias("is_control"),
    )


def skus(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("sku_id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_retailprice").alias("list_price"),
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales lines.  Orders meet customers first, so the large line table is
    shuffled once, on the order key."""
    orders = read_table(spark, folder, "orders")
    customer = read_table(spark, folder, "customer")
    lines = read_table(spark, folder, "lineitem")
    header = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(F.col("c_mktsegment") == "MACHINERY", config.EXCLUDED_CHANNEL).otherwise("RETAIL").alias("channel"),
        F.when(F.col("o_orderstatus") == "P", config.EXCLUDED_TXN_TYPE).otherwise("SALE").alias("txn_type"),
    )
    gross = F.col("l_extendedprice")
    discount = gross * F.col("l_discount")
    return lines.join(header, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("txn_id"),
        F.col("l_suppkey").alias("store_id"),
        F.when(
            (F.col("l_suppkey") % 33 == 0) & (F.col("txn_date") >= F.lit(CODE_CHANGE_DATE).cast("date")),
            F.concat(F.lit("RC-"), F.col("l_suppkey").cast("string"), F.lit("-N")),
        ).otherwise(F.concat(F.lit("RC-"), F.col("l_suppkey").cast("string"))).alias("store_code"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_quantity").alias("units"),
        "txn_date",
        F.date_add("txn_date", (F.col("l_partkey") % 4).cast("int")).alias("posted_date"),
        "channel",
        "txn_type",
        gross.alias("gross_amount"),
        discount.alias("discount_amount"),
        ((gross - discount) * F.col("l_tax")).alias("tax_amount"),
        F.when(F.col("l_returnflag") == "R", gross - discount).otherwise(0.0).alias("returns_amount"),
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Shelf snapshots: one per line, hour 4 of the line number is 12:00."""
    return read_table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("l_shipdate").cast("date").alias("snapshot_date"),
        F.when(F.col("l_linenumber") == 4, config.SNAPSHOT_HOUR).otherwise(F.col("l_linenumber")).alias("snapshot_hour"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0).alias("on_hand_units"),
    )


def assortment(spark: SparkSession, folder: str) -> DataFrame:
    key = (F.col("p_partkey") % 365).cast("int")
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("sku_id"),
        F.date_add(F.lit(ASSORTMENT_START).cast("date"), key).alias("valid_from"),
        F.date_sub(F.lit(ASSORTMENT_END).cast("date"), key).alias("valid_to"),
    )


def qcomm_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Quick-commerce orders built from their lines; all parts combine map-side."""
    lines = read_table(spark, folder, "lineitem")
    orders = read_table(spark, folder, "orders")
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey"))["l_suppkey"]
    per_order = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines_ordered"),
        F.count_if(F.col("l_linestatus") == "F").alias("lines_shipped"),
        F.max("l_shipdate").cast("date").alias("delivered_date"),
        first.alias("dark_store_id"),
    )
    return per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        "dark_store_id",
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.when(F.col("o_orderstatus") == "P", config.EXCLUDED_TXN_TYPE).otherwise("SALE").alias("txn_type"),
        "lines_ordered",
        "lines_shipped",
        "delivered_date",
        F.date_add(F.col("o_orderdate").cast("date"), PROMISE_DAYS).alias("promised_date"),
    )


def feed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Feed rows: event type is the feed, user is the store."""
    return read_table(spark, folder, "events").select(
        F.col("event_id"),
        F.col("event_type").alias("feed"),
        F.col("user_id").alias("store_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("feed_date"),
        F.col("value").alias("amount"),
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Store-day footfall; null where the store has no counter."""
    feed = feed_events(spark, folder)
    instrumented = F.col("store_id") % 4 == 0
    return (
        feed.groupBy("store_id", F.col("feed_date").alias("footfall_date"))
        .agg(F.count_if(F.col("feed") == "view").alias("n"))
        .select(
            "store_id", "footfall_date",
            F.when(instrumented, F.col("n")).alias("footfall"),
            instrumented.alias("counter_installed"),
        )
    )


def till_events(spark: SparkSession, folder: str) -> DataFrame:
    """Till transactions in the same stores as :func:`visits`; some are wholesale, some transfers."""
    key = F.col("event_id")
    return feed_events(spark, folder).where(F.col("feed") == "purchase").select(
        key.alias("txn_id"), "store_id", F.col("feed_date").alias("txn_date"),
        F.when(key % 10 == 3, config.EXCLUDED_CHANNEL).otherwise("RETAIL").alias("channel"),
        F.when(key % 17 == 5, config.EXCLUDED_TXN_TYPE).otherwise("SALE").alias("txn_type"),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Free-text notes: author is source plus language, date from the id."""
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("note_id"),
        F.concat_ws("-", "source", "lang").alias("author"),
        F.col("source").alias("store_id"),
        F.col("lang").alias("note_group"),
        F.date_add(F.lit(NOTE_EPOCH).cast("date"), (F.col("doc_id") % 730).cast("int")).alias("note_date"),
        F.col("text").alias("body"),
        "n_chars",
    )


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence rows over the notes: tier, hypothesis and sign from their columns."""
    kinds = F.array(*map(F.lit, config.RELIABILITY))
    hypotheses = F.array(*map(F.lit, config.HYPOTHESES))
    key = F.col("doc_id")
    by_model = key % 5 == 0
    return read_table(spark, folder, "documents").select(
        key.alias("evidence_id"),
        F.element_at(hypotheses, (key % len(config.HYPOTHESES) + 1).cast("int")).alias("hypothesis"),
        F.element_at(kinds, (F.col("n_chars") % len(config.RELIABILITY) + 1).cast("int")).alias("kind"),
        F.when(by_model, "model").otherwise("code").alias("produced_by"),
        F.concat_ws("-", "source", "lang").alias("source_ref"),
        F.when(F.col("n_chars") % 3 == 0, -1).when(F.col("n_chars") % 3 == 1, 1).otherwise(0).alias("sign"),
        F.when(~by_model | (key % 25 == 0), F.col("n_chars").cast("double")).alias("value_num"),
        F.when(by_model, F.col("lang")).alias("value_text"),
        F.element_at(F.array(*map(F.lit, config.EVIDENCE_UNITS)), (key % len(config.EVIDENCE_UNITS) + 1).cast("int")).alias("unit"),
        (F.col("n_chars") % 120).cast("double").alias("freshness_hours"),
        (F.lit(1.0) - (F.col("n_chars") % 100) / 1000.0).alias("completeness"),
        F.add_months(F.lit(CASE_EPOCH).cast("date"), (key % CASE_MONTHS).cast("int")).alias("period"),
    )


def source_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Loads of the held sources: one a source and order day, from the orders that fall to it.

    An order still pending is a row the load did not bring, so it lowers completeness.
    """
    names = F.array(*map(F.lit, config.HELD_SOURCES))
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = read_table(spark, folder, "orders").select(
        F.element_at(names, (F.floor(key / 4) % len(config.HELD_SOURCES) + 1).cast("int")).alias("source"),
        day.alias("day"), (day.cast("timestamp") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("at"),
        (F.col("o_orderstatus") == "P").cast("int").alias("pending"),
    )
    return rows.groupBy("source", "day").agg(
        F.max("at").alias("loaded_at"),
        F.round(F.lit(1.0) - F.sum("pending") / F.count(F.lit(1)), 6).alias("completeness"),
    ).drop("day")
