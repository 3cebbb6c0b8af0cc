"""Calibration curves of each case type, against the definition of the isotonic fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from kpisleuth.operators import confidence


def plain(scores, outcomes):
    """Largest, over starts at or below, of the smallest mean to any end at or above."""
    at = np.unique(scores)
    ones = np.array([outcomes[scores == s].sum() for s in at], dtype=float)
    cases = np.array([(scores == s).sum() for s in at], dtype=float)
    mean = lambda a, b: ones[a: b + 1].sum() / cases[a: b + 1].sum()
    n = len(at)
    return at, np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def made(seed=2, n=300):
    draw = np.random.default_rng(seed)
    kind = draw.choice(["a", "b", "c"], n, p=[0.8, 0.17, 0.03])
    score = draw.random(n).round(2)
    return pd.DataFrame({"kind": kind, "score": score, "outcome": (draw.random(n) < score ** 2).astype(int)})


@pytest.mark.parametrize("parts", [1, 7])
def test_curves_equal_the_definition_however_they_are_dealt(spark, parts):
    frame = made()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        curve = confidence.calibration_curve(spark.createDataFrame(frame), ["kind"], "kind string", "score", "outcome")
        closed = spark.createDataFrame(frame[["kind", "score"]].drop_duplicates())
        got = confidence.calibrated(closed, curve, ["kind"], "score", 1).toPandas()
        blocks = curve.toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for kind, part in frame.groupby("kind"):
        at, want = plain(part["score"].to_numpy(), part["outcome"].to_numpy())
        mine = got[got["kind"] == kind].set_index("score")["calibrated"]
        assert [mine[s] for s in at] == pytest.approx(want.tolist())
        steps = blocks[blocks["kind"] == kind].sort_values("score_from")
        assert steps["calibrated"].is_monotonic_increasing and steps["calibrated"].is_unique
        assert steps["cases"].sum() == len(part)


def test_parts_pool_to_the_same_blocks():
    """Pooling pooled parts equals pooling all points at once."""
    draw = np.random.default_rng(5)
    points = [(float(i), float(i), float(draw.integers(0, w + 1)), float(w)) for i, w in enumerate(draw.integers(1, 6, 200))]
    whole, again = confidence._Blocks(), confidence._Blocks()
    for p in points:
        whole.add(*p)
    for cut in range(0, 200, 23):
        part = confidence._Blocks()
        for p in points[cut: cut + 23]:
            part.add(*p)
        for row in part.rows:
            again.add(*row)
    assert again.rows == whole.rows


def test_lookup_below_between_and_without_a_curve(spark):
    curve = spark.createDataFrame([("a", 0.2, 0.3, 4, 0.1), ("a", 0.5, 0.9, 6, 0.7), ("b", 0.1, 0.1, 2, 1.0)],
                                  "kind string, score_from double, score_to double, cases long, calibrated double")
    cases = spark.createDataFrame([("a", 0.0), ("a", 0.2), ("a", 0.45), ("a", 0.5), ("a", 1.0), ("b", 0.4), ("c", 0.4)], "kind string, score double")
    got = {(r["kind"], r["score"]): (r["calibrated"], r["calibration_cases"]) for r in confidence.calibrated(cases, curve, ["kind"], "score").collect()}
    assert got == {("a", 0.0): (0.1, 10), ("a", 0.2): (0.1, 10), ("a", 0.45): (0.1, 10), ("a", 0.5): (0.7, 10), ("a", 1.0): (0.7, 10),
                   ("b", 0.4): (0.4, 2), ("c", 0.4): (0.4, 0)}


def test_empty_and_null_cases(spark):
    kind = "kind string, score double, outcome int"
    assert confidence.calibration_curve(spark.createDataFrame([], kind), ["kind"], "kind string", "score", "outcome").count() == 0
    rows = [("a", None, 1), ("a", 0.5, None), ("a", 0.5, 1), ("a", 0.4, 1)]
    got = confidence.calibration_curve(spark.createDataFrame(rows, kind), ["kind"], "kind string", "score", "outcome").collect()
    assert [tuple(r) for r in got] == [("a", 0.4, 0.5, 2, 1.0)]
