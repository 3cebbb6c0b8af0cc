"""Matching against brute force, including duplicates and a crowded cell."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.functions import udf

from kpisleuth.operators import matching

COVARIATES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def units():
    rng = np.random.default_rng(11)
    n = 240
    points = rng.normal(size=(n, 3)) * [1.0, 50.0, 5.0]
    points[:80] = points[0] + rng.normal(size=(80, 3)) * 1e-4      # a third of all units in one clump
    points[80:160] = points[80]                                     # a third are exact copies
    points[160] = [40.0, 2000.0, 100.0]                             # far outlier
    frame = pd.DataFrame(points, columns=COVARIATES)
    frame["unit"] = rng.permutation(n)
    frame["block"] = np.where(np.arange(n) % 2, "x", "y")
    frame["is_case"] = frame["unit"] % 4 == 0
    return frame


def standard(frame):
    pool = frame.loc[~frame.is_case, COVARIATES]
    deviation = pool.std(ddof=0).replace(0, 1.0)
    return (frame[COVARIATES] - pool.mean()) / deviation


def brute(frame, reuse):
    out = {}
    for _, part in frame.groupby("block"):
        z = standard(part).to_numpy()
        cases = part.index[part.is_case].to_list()
        pool = [i for i in part.index if not part.is_case[i]]
        at = {i: k for k, i in enumerate(part.index)}
        used = set()
        for i in sorted(cases, key=lambda k: part.unit[k]):
            free = [j for j in pool if reuse or j not in used]
            if not free:
                continue
            best = min(free, key=lambda j: (np.sqrt(((z[at[i]] - z[at[j]]) ** 2).sum()), part.unit[j]))
            used.add(best)
            out[part.unit[i]] = (part.unit[best], float(np.sqrt(((z[at[i]] - z[at[best]]) ** 2).sum())))
    return out


@pytest.mark.parametrize("reuse", [True, False])
def test_against_brute_force(spark, units, reuse):
    small = units if reuse else units.sort_values("unit").head(90).reset_index(drop=True)
    match = matching.match_with_reuse if reuse else matching.match_without_reuse
    got = match(spark.createDataFrame(small), ["block"], COVARIATES, "unit", "is_case").collect()
    want = brute(small, reuse)
    assert {r["treated_id"] for r in got} == set(want)
    for r in got:
        assert r["distance"] == pytest.approx(want[r["treated_id"]][1], abs=1e-9)
        assert r["candidate_id"] == want[r["treated_id"]][0]
    if not reuse:
        assert len({(r["block"], r["candidate_id"]) for r in got}) == len(got)


def test_scores_that_differ_in_their_last_bits_when_computed_again(spark, units, monkeypatch):
    """Partial sums arrive in any order on a cluster; here every evaluation moves a score a little."""
    stir = udf(lambda z: z + random.SystemRandom().random() * 1e-12, "double").asNondeterministic()
    exact = matching.standardise
    monkeypatch.setattr(matching, "standardise", lambda *given: exact(*given).withColumn("z_a", stir("z_a")))
    small = units.sort_values("unit").head(90).reset_index(drop=True)
    got = matching.match_with_reuse(spark.createDataFrame(small), ["block"], COVARIATES, "unit", "is_case").collect()
    want = brute(small, True)
    assert {r["treated_id"] for r in got} == set(want)
    for r in got:
        assert r["distance"] == pytest.approx(want[r["treated_id"]][1], abs=1e-6)
