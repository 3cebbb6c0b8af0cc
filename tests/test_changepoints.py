"""Changepoints against the whole dynamic programme, and which change came first."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from kpisleuth.operators import causal


def plain(values, penalty, min_size=2):
    """Every end and every start."""
    n = len(values)
    c1, c2 = np.concatenate([[0.0], np.cumsum(values)]), np.concatenate([[0.0], np.cumsum(values**2)])
    best, previous = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    for end in range(min_size, n + 1):
        starts = np.arange(end - min_size + 1)
        totals = best[starts] + c2[end] - c2[starts] - (c1[end] - c1[starts]) ** 2 / (end - starts) + penalty
        best[end], previous[end] = totals.min(), totals.argmin()
    cuts, end = [], n
    while end > 0:
        end = int(previous[end])
        cuts += [end] * (end > 0)
    return sorted(cuts), best[n]


def cost(values, cuts, penalty):
    edges = [0, *cuts, len(values)]
    return sum(((values[a:b] - values[a:b].mean()) ** 2).sum() for a, b in zip(edges, edges[1:], strict=False)) + penalty * len(cuts)


@pytest.mark.parametrize("min_size", [1, 2, 5])
def test_pruning_loses_nothing(min_size):
    draw = np.random.default_rng(min_size)
    for _ in range(10_000 if min_size == 2 else 2_000):
        n = int(draw.integers(2 * min_size, 36))
        values = draw.normal(0.0, 1.0, n) + np.repeat(draw.normal(0.0, 2.0, 6), 6)[:n]
        penalty = float(draw.choice([0.1, 0.5, 2.0, 8.0]))
        cuts = causal._changepoints(values, penalty, min_size)
        want, least = plain(values, penalty, min_size)
        assert cuts == want
        assert cost(values, cuts, penalty) == pytest.approx(least)
        assert np.diff([0, *cuts, n]).min() >= min_size


def test_steps_are_found_where_they_are(spark):
    day = dt.date(2024, 1, 1)
    values = [1.0, 1.1, 0.9, 1.0, 1.05, 5.0, 5.1, 4.9, 5.0, 2.0, 2.1, 1.9, 2.0]
    rows = [("a", day + dt.timedelta(days=i), v) for i, v in enumerate(values)] + [("a", dt.date(2023, 1, 1), None)]
    rows += [("b", day + dt.timedelta(days=i), 3.0) for i in range(10)] + [("c", day, 1.0)]
    found = causal.onsets(spark.createDataFrame(rows, "k string, day date, value double"), ["k"], "k string", "day").collect()
    assert sorted((r["k"], r["position"], round(r["shift"], 2)) for r in found) == [("a", 5, 3.99), ("a", 9, -3.0)]


def test_precedence_takes_the_nearest_cause(spark):
    at = lambda *days: [("R", dt.date(2024, 1, 1) + dt.timedelta(days=d)) for d in days]
    causes = spark.createDataFrame(at(10, 40, 200), "region string, onset date")
    effects = spark.createDataFrame(at(5, 10, 45, 130) + [("S", dt.date(2024, 1, 1))], "region string, onset date")
    found = {(r["region"], (r["effect_onset"] - dt.date(2024, 1, 1)).days): (r["lag_days"], r["passed"])
             for r in causal.precedence(causes, effects, ["region"]).collect()}
    assert found == {("R", 5): (-5, False), ("R", 10): (0, False), ("R", 45): (5, True), ("R", 130): (90, False), ("S", 0): (None, False)}
