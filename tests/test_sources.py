"""Required sources by name: the last load before the end of a case's month."""

from __future__ import annotations

import datetime as dt

from kpisleuth.operators import confidence

D = dt.datetime


def quality(spark, loads, months, required):
    loads = spark.createDataFrame(loads, "source string, loaded_at timestamp, completeness double")
    cases = spark.createDataFrame([(m,) for m in months], "period date")
    templates = spark.createDataFrame(list(required.items()), "hypothesis string, required_sources array<string>")
    names = spark.createDataFrame([(s,) for s in sorted({s for r in required.values() for s in r})], "source string")
    states = confidence.source_states(loads, names, cases)
    rows = confidence.required_quality(states, templates, 24.0, 96.0).collect()
    assert len(rows) == len(months) * len(required)
    return {(r["hypothesis"], r["period"].month): (round(r["data_quality"], 9), r["staleness_hours"]) for r in rows}


def test_worst_required_source_at_the_case_date(spark):
    loads = [
        ("pos", D(2025, 1, 31, 12), 1.0), ("pos", D(2025, 1, 10), 0.1), ("pos", D(2025, 2, 28, 12), 0.9), ("pos", D(2025, 3, 1), 0.2),
        ("erp", D(2025, 1, 30), 0.8), (None, D(2025, 1, 31), 1.0), ("erp", None, 1.0),
    ]
    months = [dt.date(2025, 1, 1), dt.date(2025, 2, 1), dt.date(2024, 12, 1)]
    got = quality(spark, loads, months, {"mix": ["pos", "erp"], "pos_only": ["pos"], "rival": ["pos", "rival_prices"]})
    assert got["pos_only", 1] == (1.0, 12.0)
    assert got["pos_only", 2] == (0.9, 12.0)  # the load at the month's end belongs to the next
    assert got["mix", 1] == (round(0.8 * (96 - 48) / 72, 9), 48.0)
    assert got["mix", 2] == (0.0, (D(2025, 3, 1) - D(2025, 1, 30)).total_seconds() / 3600)
    never = (0.0, float("inf"))
    assert got["rival", 1] == got["rival", 2] == got["pos_only", 12] == got["mix", 12] == never


def test_repeated_loads_and_no_loads(spark):
    months = [dt.date(2025, 1, 1)]
    twice = [("pos", D(2025, 1, 31, 12), 0.9), ("pos", D(2025, 1, 31, 12), 0.7), ("pos", D(2025, 1, 31, 12), 0.9)]
    assert quality(spark, twice, months, {"h": ["pos"]})["h", 1] == (0.7, 12.0)
    assert quality(spark, [], months, {"h": ["pos"]})["h", 1] == (0.0, float("inf"))


def test_a_hot_source_is_reduced_before_the_lookup(spark):
    """A third of all loads in one source: one row a month of it meets the window."""
    loads = [("pos", D(2025, 1, 1) + dt.timedelta(minutes=i), 1.0) for i in range(3000)] + [("erp", D(2025, 1, 31, 12), 0.5)]
    got = quality(spark, loads, [dt.date(2025, 1, 1)], {"h": ["pos"], "g": ["erp"]})
    assert got["g", 1] == (0.5, 12.0) and got["h", 1][0] == 0.0
