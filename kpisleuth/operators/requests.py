"""Text requests, their fingerprints, the response cache join, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.scale import exact_percentiles
from kpisleuth.session import written


def message_request(df: DataFrame, request_id: str, task: str, content: str,
                    system: str | None, max_tokens: int = config.DEFAULT_MAX_TOKENS) -> DataFrame:
    """One request per row of text.  Each row carries its whole message, so no
    group is ever assembled."""
    return df.select(
        F.col(request_id).alias("request_id"),
        F.lit(task).alias("task"),
        F.lit(config.TASK_MODEL[task]).alias("model"),
        F.lit(system).cast("string").alias("system"),
        F.lit(max_tokens).alias("max_tokens"),
        F.array(F.struct(F.lit("user").alias("role"), F.col(content).alias("content"))).alias("messages"),
    )


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Long form of multi-turn requests: one row per message, positioned by turn.

    A conversation of any length stays spread over its rows.
    """
    return turns.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content")
    )


def conversation_requests(turns: DataFrame, task: str, system: str | None = None,
                          max_tokens: int = config.DEFAULT_MAX_TOKENS) -> DataFrame:
    """One request per conversation, with all its messages in the order of turns.

    A request is one object on the wire and is hashed as one, so its messages
    meet in one row; a model's context bounds it.  Work on single messages goes
    through :func:`conversation_messages`, which never assembles them.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy(F.col("conv_id").alias("request_id")).agg(ordered.alias("turns")).select(
        "request_id",
        F.lit(task).alias("task"),
        F.lit(config.TASK_MODEL[task]).alias("model"),
        F.lit(system).cast("string").alias("system"),
        F.lit(max_tokens).alias("max_tokens"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"),
    )


def _wire_messages() -> Column:
    return F.transform("messages", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))


def messages_json() -> Column:
    """The messages as compact JSON with sorted keys and nulls kept."""
    return F.to_json(_wire_messages(), {"ignoreNullFields": "false"})


def canonical_json(requests: DataFrame) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    fields = F.struct(
        F.lit(None).cast("string").alias("effort"),
        F.col("max_tokens").alias("max_tokens"),
        _wire_messages().alias("messages"),
        F.col("model").alias("model"),
        F.array().cast("array<string>").alias("stop_sequences"),
        F.col("system").alias("system"),
        F.col("task").alias("task"),
        F.lit(None).cast("double").alias("temperature"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def fingerprint(requests: DataFrame) -> DataFrame:
    return requests.withColumn("fingerprint", F.sha2(canonical_json(requests), 256))


def resolve(requests: DataFrame, cache: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Attach cached responses; every distinct request is looked up once.

    Distinct fingerprints are joined to the cache and the outcome joined back,
    so many copies of one request cost one lookup.
    """
    found = requests.select(key).distinct().join(cache, key, "left").select(
        key, "response", F.col("response").isNotNull().alias("hit")
    )
    return requests.join(found, key, "left")


def misses(requests: DataFrame, cache: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Requests still to be answered, each once, with how many rows want it."""
    return requests.groupBy(key).agg(F.count(F.lit(1)).alias("waiting")).join(cache, key, "left_anti")


def telemetry(events: DataFrame, dims: list[str], counters: list[str] | None = None) -> DataFrame:
    """Events, total cost, counters (tokens) and exact P95 duration, rolled up over the dimensions.

    Events are first summed per (dimensions, duration), map-side.  Such rows are
    mergeable: every level of the roll-up is a sum of them, and the percentile of
    a level goes through the distributed order statistics instead of one task per
    group.  A missing dimension value is a group of its own, told apart from the
    total by ``level``; a counter that no event of a group has stays null.
    """
    counters = counters or []
    solid = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in dims]
    counted = written(
        events.groupBy(*solid, "duration_ms").agg(
            F.count(F.lit(1)).alias("events"), F.sum("cost").alias("cost"), *[F.sum(c).alias(c) for c in counters]),
        "telemetry-counts",
    )
    levels = F.array(*[
        F.struct(F.lit(n).alias("level"), *[(F.col(d) if d in dims[:n] else F.lit("")).alias(f"_{d}") for d in dims])
        for n in range(len(dims), -1, -1)
    ])
    spread = counted.select("duration_ms", "events", "cost", *counters, F.inline(levels))
    keys = ["level", *[f"_{d}" for d in dims]]
    totals = spread.groupBy(*keys).agg(
        F.sum("events").alias("events"), F.round(F.sum("cost"), 4).alias("cost"), *[F.sum(c).alias(c) for c in counters])
    p95 = exact_percentiles(spread.where("duration_ms IS NOT NULL"), keys, "duration_ms", {"p95_ms": 0.95}, "events")
    return totals.join(p95, keys, "left").select(
        "level", *[F.nullif(F.col(f"_{d}"), F.lit("")).alias(d) for d in dims], "events", "cost", *counters,
        F.round("p95_ms", 6).alias("p95_ms"),
    )
