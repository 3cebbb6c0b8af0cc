"""Streaming KPI with restatement, and feed-silence alerts.

Both are plain Structured Streaming plans: watermark, event-time window, append
output.  ``run_available`` drives a stream over everything available and writes
a table in the shared folder, so results never pass through the driver.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.session import scratch_path


def read_stream(spark: SparkSession, folder: str, schema, files: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Stream of the files of a folder with a declared schema and bounded
    micro-batches; ``files`` is a glob pattern of the names to take."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    return reader.parquet(folder)


def closing_stream(spark: SparkSession, schema, name: str) -> tuple[DataFrame, str]:
    """A second source for rows sent after all data, and the folder it watches."""
    folder = scratch_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder), folder


def stream_kpi(stream: DataFrame, keys: list[str], ts: str, amount: str, kpi: str = "net_revenue") -> DataFrame:
    """Daily total per key; a day stays open for the restatement window."""
    days = config.KPIS[kpi]["restatement_window_days"]
    return (
        stream.withWatermark(ts, f"{days} days")
        .groupBy(F.window(ts, "1 day"), *keys)
        .agg(F.count(F.lit(1)).alias("items"), F.sum(amount).alias("total"))
        .select(*keys, F.col("window.start").cast("date").alias("day"), "items", F.round("total", 2).alias("total"))
    )


def stream_freshness(stream: DataFrame, feed: str, ts: str, sla_hours: int, lateness: str = "1 hour") -> DataFrame:
    """Alert when a feed has been silent for its SLA.

    A session window with the SLA as its gap closes exactly when the feed has
    been silent that long; the session's end is the moment of the alert.
    """
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, f"{sla_hours} hours").alias("s"), feed)
        .agg(F.count(F.lit(1)).alias("items"))
        .select(
            feed,
            F.col("s.start").alias("active_from"),
            (F.col("s.end") - F.expr(f"INTERVAL {sla_hours} HOURS")).alias("silent_since"),
            F.col("s.end").alias("alert_at"),
            "items",
        )
    )


@contextmanager
def lent_settings(spark: SparkSession, settings: dict[str, str]):
    """Settings that hold inside the block; the session's own come back after it."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_available(spark: SparkSession, streaming: DataFrame, name: str, close=None) -> DataFrame:
    """Process what is available, then return the written table.

    ``close`` is called when all data is through; it may send rows past the
    watermark, and the stream runs on from its state to emit the open windows.
    """
    path = scratch_path(spark, name)
    for turn in range(1 if close is None else 2):
        if turn:
            close()
        query = (
            streaming.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{path}-state").option("path", path)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(streaming.schema).parquet(path)
