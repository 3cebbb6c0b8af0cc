"""The store tests of the board on stores without any effect, and with one."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from kpisleuth import config
from kpisleuth.plans import verdicts
from kpisleuth.plans.verdicts import cause_months, store_outcomes

MONTHS = [dt.date(1998, 1, 1), dt.date(1998, 2, 1), dt.date(1998, 3, 1)]
SLICES = len(config.HYPOTHESES)
HIT = 3  # the slice whose cause matters where an effect is injected


def world(spark, stores, regions, effect=0.0, seed=1):
    """Sales and shelf checks of every (store, month, slice); in March the cause of one slice falls in every other store."""
    draw = np.random.default_rng(seed)
    shape = (regions, stores, len(MONTHS), SLICES)
    region, store, month, slot = (a.ravel() for a in np.indices(shape))
    net = 1000.0 * np.exp(draw.normal(0.0, 0.3, shape))
    checks = np.full(shape, 20)
    found = draw.binomial(20, 0.9, shape)
    hit = np.arange(stores) % 2 == 0
    if effect:
        found[:, hit, 2, HIT] = draw.binomial(20, 0.4, (regions, hit.sum()))
        found[:, ~hit, 2, HIT] = found[:, ~hit, 1, HIT]
        net[:, hit, 2, :] *= 1.0 - effect
    keys = {"region": [f"R{r}" for r in region], "store_id": region * stores + store, "period": [MONTHS[m] for m in month],
            "hypothesis_no": slot.astype("int32")}
    kind = "region string, store_id long, period date, hypothesis_no int"
    slices = spark.createDataFrame(pd.DataFrame({**keys, "net": net.ravel(), "n": 1}), f"{kind}, net double, n long")
    causes = spark.createDataFrame(pd.DataFrame({**keys, "ok": found.ravel(), "n": checks.ravel()}), f"{kind}, ok long, n long")
    return slices, causes


def outcomes(spark, stores, regions, effect=0.0):
    slices, causes = world(spark, stores, regions, effect)
    moves = cause_months(causes)
    rows = verdicts.tested_slices(slices, causes, moves).join(moves, ["region", "period", "hypothesis_no"]).where("period = '1998-03-01'").toPandas()
    agrees = lambda name: np.sign(rows[f"{name}_t"]) == np.sign(rows["change"])
    return rows.assign(dose=rows["dose_r"] >= config.DOSE_MIN_R, spec=(rows["spec_p"] <= config.SPECIFICITY_MAX_P) & agrees("spec"),
                       did=(rows["did_p"] <= config.DID_MAX_P) & agrees("did"), pre=rows["pre_p"] > config.PRETREND_MIN_P)


@pytest.mark.parametrize(("stores", "regions"), [(30, 20), (300, 10), (3000, 3)])
def test_noise_passes_at_the_nominal_level(spark, stores, regions):
    rows = outcomes(spark, stores, regions)
    cases = regions * SLICES
    assert 0.95 * cases <= len(rows) <= cases  # a cause that stood still in a region tests nothing
    # Nominal shares, with three standard errors; the correlation of n independent stores is about N(0, 1/n).
    slack = lambda p: p + 3.0 * (p * (1.0 - p) / cases) ** 0.5
    assert rows["dose"].mean() <= slack({30: 0.055, 300: 1e-6, 3000: 1e-6}[stores])
    assert rows["spec"].mean() <= slack(config.SPECIFICITY_MAX_P / 2)
    assert rows["did"].mean() <= slack(config.DID_MAX_P / 2)
    assert 1.0 - rows["pre"].mean() <= slack(config.PRETREND_MIN_P)


def test_an_injected_effect_is_found_and_only_there(spark):
    rows = outcomes(spark, 300, 4, effect=0.3)
    real, other = rows[rows["hypothesis_no"] == HIT], rows[rows["hypothesis_no"] != HIT]
    assert real[["dose", "spec", "did", "pre"]].to_numpy().all()
    assert (real["did_pt"] < -10.0).all()  # thirty percent of half the stores
    assert other["did"].mean() <= 0.06 and other["dose"].mean() == 0.0


def test_a_slice_is_left_out_of_its_own_outcome(spark):
    slices, causes = world(spark, 3, 1)
    net = {(r["store_id"], r["period"], r["hypothesis_no"]): r["net"] for r in slices.collect()}
    rows = store_outcomes(slices, causes).where("period = '1998-03-01'").collect()
    assert len(rows) == 3 * SLICES
    for r in rows:
        now, before, earlier = (sum(net[r["store_id"], m, h] for h in range(SLICES) if h != r["hypothesis_no"]) for m in reversed(MONTHS))
        assert (r["now"], r["before"], r["earlier"]) == pytest.approx((now, before, earlier))
        assert r["growth"] == pytest.approx(now / before - 1.0, abs=1e-6) and r["growth_before"] == pytest.approx(before / earlier - 1.0, abs=1e-6)


def test_gaps_and_stores_without_sales_or_causes(spark):
    """No cause last month, no row; no sales of the slice, the whole store counts; equal levels, no test."""
    kind = "region string, store_id long, period date, hypothesis_no int"
    slices = spark.createDataFrame([("R", 1, m, 1, 100.0 * (i + 1), 1) for i, m in enumerate(MONTHS)] + [("R", 2, MONTHS[2], 0, 5.0, 1)],
                                   f"{kind}, net double, n long")
    causes = spark.createDataFrame([("R", 1, MONTHS[1], 0, 1, 2), ("R", 1, MONTHS[2], 0, 2, 4), ("R", 2, MONTHS[0], 0, 1, 2),
                                    ("R", 2, MONTHS[2], 0, 1, 2)], f"{kind}, ok long, n long")
    rows = store_outcomes(slices, causes).collect()
    assert [(r["store_id"], r["driver"], r["now"], r["before"], r["earlier"]) for r in rows] == [(1, 0.0, 300.0, 200.0, 100.0)]
    assert verdicts.tested_slices(slices, causes, cause_months(causes)).count() == 0
