"""Tasks of the queries over the facts are sized by their data."""

from __future__ import annotations

import datetime as dt
import glob

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from kpisleuth.operators import kpis
from kpisleuth import session
from kpisleuth.plans import all_queries, operations, verdicts
from kpisleuth.sources import standins

ON_THE_BOARD = [
    "m3_sufficiency", "m12_missing_sources", "m13_test_coverage", "f1_components", "f2_raw_confidence", "f3_caps", "f6_triggers",
    "f8_leading", "q4_elimination_breaks", "r1_action_cost", "r2_recovery_range", "r3_roi", "r4_rank_actions", "r5_checkpoints",
    "r6_eligible_actions", "r7_linked_cases",
]


def test_more_rows_make_more_tasks_not_larger_ones(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        all_queries()["k1_net_revenue"].run(spark, SMALL)
        dealt = spark.range(1_000_000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition("k")
        assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    finally:
        spark.conf.set(key, before)


def test_kpis_of_one_table_share_its_rows(spark):
    schema = "region string, store_id long, period date"
    day = dt.date(1998, 1, 5)
    sold = spark.createDataFrame([("N", 1, day, 1.5, 7), ("N", 2, day, None, 3)], f"{schema}, net double, bills long")
    rate = spark.createDataFrame([("N", 1, day, 90.0), ("S", 3, day, 80.0)], f"{schema}, value double")
    got = kpis.kpi_panel({"net": sold, "rate": rate, "bills": sold}, kpis.CELL)
    assert got.columns == [*kpis.CELL, "net", "rate", "bills"]
    assert sorted(map(tuple, got.collect())) == [
        ("N", 1, day, 1.5, 90.0, 7.0), ("N", 2, day, None, None, 3.0), ("S", 3, day, None, 80.0, None)]


def test_verdict_joins_the_lines_twice_at_most(spark, monkeypatch):
    """Once for the slices, from which the gates take their months, and once for the days of the band."""
    seen, sales = [], standins.sales
    monkeypatch.setattr(standins, "sales", lambda *a: seen.append(a) or sales(*a))
    verdicts.verdict_cases(spark, SMALL)
    assert len(seen) == 2


@pytest.mark.parametrize("name", ON_THE_BOARD)
def test_board_is_made_with_tasks_of_bounded_size(spark, monkeypatch, name):
    """Whatever the caller's session says: a dozen partitions would hold a twelfth of the lines each."""
    class Reached(Exception):
        pass

    def board(spark, *rest):
        raise Reached({key: spark.conf.get(key) for key in session.TASK_SETTINGS})

    for module in (verdicts, operations):
        monkeypatch.setattr(module, "hypothesis_board", board)
    monkeypatch.setattr(verdicts, "written", lambda df, name: df)
    before = {key: spark.conf.get(key, None) for key in session.TASK_SETTINGS}
    for key in before:
        spark.conf.unset(key)
    try:
        with pytest.raises(Reached) as held:
            all_queries()[name].run(spark, SMALL)
    finally:
        for key, value in before.items():
            if value is not None:
                spark.conf.set(key, value)
    assert held.value.args[0] == session.TASK_SETTINGS


def test_slices_of_the_board_leave_in_pieces_of_the_advised_size(spark, monkeypatch):
    """With one shuffle partition asked for and small pieces advised, many tasks sum the lines."""
    least, count = "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.shuffle.partitions"
    advised = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    monkeypatch.setitem(session.TASK_SETTINGS, advised, "8k")
    before = {key: spark.conf.get(key, None) for key in (least, count, advised)}
    spark.conf.set(least, "4k")
    spark.conf.set(count, "1")
    try:
        session.sized(spark)
        folder = verdicts.slice_sums(spark, SMALL).inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert len(glob.glob(f"{folder}/part-*")) >= 4
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
