"""Difference-in-differences over matched stores, against plain formulas and on made-up stores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from kpisleuth.functions.stats import p_student_t
from kpisleuth.operators import causal, matching
from pyspark.sql import functions as F

PAIR = "region string, treated_id long, candidate_id long, t_growth double, c_growth double, t_pre double, t_post double"


def pairs_of(draw, n, controls):
    return [("R", i, int(c), float(draw.normal(0.1, 0.2)), 0.05 * float(c), 100.0 + i, 120.0 - i)
            for i, c in enumerate(draw.integers(0, controls, n) if controls < n else np.arange(n))]


def plain(rows):
    gap = np.array([r[3] - r[4] for r in rows])
    sets = {}
    for r, g in zip(rows, gap, strict=True):
        sets.setdefault(r[2], []).append(g - gap.mean())
    c = len(sets)
    error = np.sqrt(sum(sum(v) ** 2 for v in sets.values()) * c / (c - 1)) / len(rows)
    return len(rows), c, 100.0 * gap.mean(), gap.mean() / error, c - 1, sum(r[6] - r[5] * (1 + r[4]) for r in rows)


@pytest.mark.parametrize("controls", [5, 40])
def test_matched_sets_share_their_error(spark, controls):
    rows = pairs_of(np.random.default_rng(2), 40, controls)
    got = causal.matched_did(spark.createDataFrame(rows, PAIR), ["region"]).first()
    want = plain(rows)
    assert [got[c] for c in ("matched", "controls", "did_pt", "t", "df", "loss")] == pytest.approx(want)
    if controls == 40:  # no control serves twice: the paired t
        gap = np.array([r[3] - r[4] for r in rows])
        assert got["t"] == pytest.approx(gap.mean() / (gap.std(ddof=1) / np.sqrt(40)))


def test_pairs_without_growth_and_single_sets(spark):
    rows = [("R", 1, 7, 0.2, 0.1, 100.0, 120.0), ("R", 2, 7, 0.4, 0.1, 100.0, 140.0), ("R", 3, 8, None, 0.1, None, 5.0), ("R", 4, 9, 0.1, None, 1.0, 1.1)]
    got = causal.matched_did(spark.createDataFrame(rows, PAIR), ["region"]).first()
    assert (got["matched"], got["controls"], got["df"], got["t"]) == (2, 1, 0, None)
    assert got["did_pt"] == pytest.approx(20.0) and got["loss"] == pytest.approx(40.0)
    assert causal.matched_did(spark.createDataFrame([], PAIR), ["region"]).count() == 0


def stores(spark, effect, seed=3, n=600):
    """Treated stores are larger, and larger stores grow faster; the treatment adds ``effect``."""
    draw = np.random.default_rng(seed)
    treated = np.arange(n) % 3 == 0
    size = draw.normal(0.0, 1.0, n) + np.where(treated, 0.6, 0.0)
    growth = 0.2 * size + np.where(treated, effect, 0.0) + draw.normal(0.0, 0.05, n)
    return spark.createDataFrame(pd.DataFrame({
        "region": "R", "store_id": np.arange(n), "size": size, "trend": draw.normal(0.0, 1.0, n), "is_treated": treated, "growth": growth,
        "pre": 100.0, "post": 100.0 * (1 + growth)}))


def estimate(units, caliper=0.5):
    pairs = matching.matched_pairs(units, ["region"], ["size", "trend"], "store_id", "is_treated", caliper, ["growth", "pre", "post"])
    found = causal.matched_did(pairs, ["region"]).join(matching.worst_imbalance(pairs, ["region"], ["size", "trend"]), "region")
    return found.withColumn("p", p_student_t("t", F.col("df").cast("double"))).first(), pairs


def test_matching_removes_what_a_covariate_explains(spark):
    units = stores(spark, 0.0)
    unmatched = causal.did(units.withColumn("is_control", ~F.col("is_treated")), ["region"]).first()
    assert unmatched["did_pt"] > 8.0  # larger stores grow faster, treatment or not
    got, _ = estimate(units)
    assert abs(got["did_pt"]) < 2.5 and got["p"] > 0.01 and got["worst_smd"] < 0.25


def test_an_effect_is_found_at_its_size(spark):
    got, _ = estimate(stores(spark, -0.1))
    assert got["did_pt"] == pytest.approx(-10.0, abs=2.5) and got["p"] < 0.001
    assert got["loss"] / 100.0 == pytest.approx(-0.1 * got["matched"], rel=0.25)


def test_the_caliper_leaves_out_what_has_no_neighbour(spark):
    units = stores(spark, 0.0, n=90)
    far = units.where("store_id = 0").withColumn("size", F.lit(50.0))
    _, pairs = estimate(units.where("store_id <> 0").unionByName(far))
    assert pairs.where("treated_id = 0").count() == 0 and pairs.where("distance > 0.5").count() == 0 and pairs.count() > 10
    everything = matching.matched_pairs(units, ["region"], ["size", "trend"], "store_id", "is_treated", 1e9, ["growth"])
    assert everything.count() == units.where("is_treated").count()


def test_imbalance_by_hand(spark):
    rows = [("R", 1.0, 2.0, 5.0, 5.0), ("R", 3.0, 2.0, 5.0, 5.0), ("R", 5.0, 5.0, 5.0, 5.0)]
    got = matching.worst_imbalance(spark.createDataFrame(rows, "region string, t_a double, c_a double, t_b double, c_b double"), ["region"], ["a", "b"])
    a, b = np.array([1.0, 3.0, 5.0]), np.array([2.0, 2.0, 5.0])
    assert got.first()["worst_smd"] == pytest.approx(abs(a.mean() - b.mean()) / np.sqrt((a.var() + b.var()) / 2))
    alike = spark.createDataFrame([("R", 1.0, 2.0)], "region string, t_a double, c_a double")
    assert matching.worst_imbalance(alike, ["region"], ["a"]).first()["worst_smd"] == float("inf")
