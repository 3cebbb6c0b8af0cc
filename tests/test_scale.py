"""Distributed order statistics against numpy, with a value that holds a third of all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kpisleuth.functions import scale
from kpisleuth.operators import conform


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    body = np.round(np.concatenate([rng.lognormal(3, 2, 400), -rng.lognormal(1, 1, 300), np.zeros(50)]), 2)
    hot = np.full(375, 7.25)
    return pd.DataFrame({"g": rng.integers(0, 3, len(body) + len(hot)), "v": np.concatenate([body, hot])})


def test_percentiles_are_exact(spark, values):
    got = scale.exact_percentiles(spark.createDataFrame(values), ["g"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p1": 1.0}).toPandas()
    for row in got.itertuples():
        own = values.loc[values.g == row.g, "v"]
        assert row.p50 == pytest.approx(np.quantile(own, 0.5))
        assert row.p95 == pytest.approx(np.quantile(own, 0.95))
        assert (row.p0, row.p1) == (own.min(), own.max())


@pytest.mark.parametrize("descending", [True, False])
def test_rank_matches_pandas(spark, values, descending):
    got = scale.competition_rank(spark.createDataFrame(values), ["g"], "v", "rank", descending).toPandas()
    want = values.assign(rank=values.groupby("g")["v"].rank(method="min", ascending=not descending).astype(int))
    order = ["g", "v", "rank"]
    assert len(got) == len(values)
    pd.testing.assert_frame_equal(
        got.sort_values(order)[order].reset_index(drop=True), want.sort_values(order)[order].reset_index(drop=True),
        check_dtype=False,
    )


def test_a_million_values_in_one_octave_are_spread(spark):
    """Epoch seconds differ by parts in a million; no range may hold much more than its share."""
    frame = spark.range(1_000_000).selectExpr("1700000000D + id AS v", "0 AS g")
    ranked = scale.cumulative_counts(frame, ["g"], "v")
    wrong = ranked.where("n <> 1 OR n_below <> v - 1700000000D OR n_total <> 1000000")
    assert ranked.count() == 1_000_000 and wrong.count() == 0
    spread = frame.repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert spread < 3 * 1_000_000 / 8


def test_infinities_and_nan_are_ordered(spark):
    numbers = [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 1.5, None]
    rows = scale.cumulative_counts(spark.createDataFrame([(0, x) for x in numbers], "g int, v double"), ["g"], "v").collect()
    assert sorted((r["n_below"], str(r["v"]), r["n"]) for r in rows) == [
        (0, "-inf", 1), (1, "0.0", 2), (3, "1.5", 1), (4, "inf", 1), (5, "nan", 1)]


def test_days_of_few_files_are_made_by_many_tasks(spark):
    members = spark.range(0, 1000, 1, 1).withColumnRenamed("id", "store_id")
    day = F.lit("1998-01-01").cast("date")
    facts = spark.range(1).select(F.col("id").alias("store_id"), F.date_add(day, 3).alias("date"), F.lit(2).alias("lines"))
    bounds = spark.range(1).select(day.alias("first_day"), F.date_add(day, 99).alias("last_day"))
    dense = conform.densify(F.broadcast(facts), members, bounds, ["store_id"], "date")
    assert dense.count() == 100_000 and dense.where("lines = 2").count() == 1
    shares = [r["count"] for r in dense.groupBy(F.spark_partition_id()).count().collect()]
    assert max(shares) < 30_000
