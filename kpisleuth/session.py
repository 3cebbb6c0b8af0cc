"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change plans.  Cluster sizing (executors, memory) is left to
# spark-submit; the shuffle partition count is only a ceiling because AQE
# coalesces it, so a large cluster passes a larger value.
PLAN_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where a later aggregate then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows can hold whole documents: small batches bound a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Tasks of the queries over the facts are sized by their data, not by the number
# of shuffle partitions: a shuffle starts with many and AQE joins them up to the
# advised size.  With as few as cores, a task's sorts and hash maps would grow
# with the tables.
TASK_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "720",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def get_spark(app: str = "kpisleuth", master: str | None = None, **settings: str) -> SparkSession:
    """Build (or reuse) a session with the plan settings above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PLAN_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tuned(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a session built elsewhere."""
    for key, value in PLAN_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def sized(spark: SparkSession) -> SparkSession:
    """:func:`tuned`, and tasks of bounded size; a session that asks for more partitions keeps its number."""
    first, most = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions"
    count = max(int(TASK_SETTINGS[first]), int(spark.conf.get(most)))
    for key, value in {**TASK_SETTINGS, first: str(count)}.items():
        spark.conf.set(key, value)
    return tuned(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder; on a
    cluster a missing setting is an error rather than a machine-local path.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="kpisleuth-checkpoint-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one run's written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """Write a shared intermediate once and read it back.

    Used where several branches of one query need the same reduced table: the
    facts are scanned once, a lost executor costs no recomputation, and the
    files give the optimizer true sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
