"""The contract's baseline against plain least squares, and what the gate makes of it."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.operators import baseline, gates

FESTIVALS = [(dt.date(1996, 10, 10), dt.date(1996, 10, 20)), (dt.date(1997, 10, 1), dt.date(1997, 10, 12))]
FIRST, LAST = dt.date(1996, 1, 1), dt.date(1997, 12, 31)


def row(day):
    """Terms of a day, written out once more."""
    dow = day.weekday()
    end = (day + dt.timedelta(days=1)).day == 1
    return [1.0, (day - dt.date(1995, 1, 1)).days / 365.25, *[float(dow == n) for n in range(1, 6)], float(dow >= 5), float(end),
            float(day.day in (1, 2, 30, 31)), float(any(a <= day <= b for a, b in FESTIVALS)),
            float((day.month, day.day) in ((1, 26), (8, 15), (10, 2)))]


DAYS = [FIRST + dt.timedelta(days=i) for i in range((LAST - FIRST).days + 1)]
EFFECTS = np.array([50.0, 4.0, 1.0, 2.0, 3.0, 8.0, 12.0, 9.0, -5.0, 6.0, 20.0, -30.0])


def cells_of(spark, values):
    """Cells of (key, day, amount) lines."""
    lines = spark.createDataFrame(values, "k string, day date, amount double")
    sums = lines.groupBy("k", F.date_trunc("month", "day").cast("date").alias("period")).agg(
        F.sum("amount").alias("net"), *baseline.moment_sums(F.col("amount"), F.col("day"), FESTIVALS))
    return baseline.with_moments(sums, ["k", "period"], "net", FESTIVALS, 1.0)


def predicted(cells, **given):
    rows = baseline.calendar_expected(cells, ["k"], "k string", FESTIVALS, **given).collect()
    return {(r["k"], r["period"]): r["expected"] for r in rows}


def plain(series, period, months):
    """Ridge least squares over the days of the months before, summed over the month's days."""
    first = period.year * 12 + period.month - months
    fit = [d for d in DAYS if first <= d.year * 12 + d.month < period.year * 12 + period.month]
    x, y = np.array([row(d) for d in fit]), np.array([series.get(d, 0.0) for d in fit])
    beta = np.linalg.solve(x.T @ x + np.diag([0.0] + [baseline.RIDGE] * 11), x.T @ y)
    return sum(np.array(row(d)) @ beta for d in DAYS if (d.year, d.month) == (period.year, period.month))


def test_terms_of_every_day(spark):
    found = spark.createDataFrame([(d,) for d in DAYS], "day date").select("day", *[
        c.alias(n) for n, c in baseline.terms(F.col("day"), FESTIVALS).items()]).collect()
    for r in found:
        assert list(r[1:]) == pytest.approx(row(r["day"]))


@pytest.mark.parametrize("months", [18, 7])
def test_against_plain_least_squares(spark, months):
    draw = np.random.default_rng(4)
    series = {d: float(draw.normal(np.array(row(d)) @ EFFECTS, 5.0)) for d in DAYS if draw.random() < 0.8}  # some days without sales
    found = predicted(cells_of(spark, [("a", d, v / 2) for d, v in series.items() for _ in range(2)]), months=months)
    held = {p: e for (_, p), e in found.items() if e is not None}
    assert min(held) == dt.date(1996, 7, 1)  # 182 days lie behind
    assert dt.date(1996, 6, 1) not in held
    for period, expected in held.items():
        assert expected == pytest.approx(plain(series, period, months), rel=1e-7)


def test_known_effects_are_foretold(spark):
    """Without noise a month is foretold to the last digit once every flag has been met."""
    series = [("a", d, float(np.array(row(d)) @ EFFECTS)) for d in DAYS]
    found = predicted(cells_of(spark, series))
    for period in (dt.date(1997, 2, 1), dt.date(1997, 10, 1)):
        actual = sum(v for _, d, v in series if (d.year, d.month) == (period.year, period.month))
        assert found["a", period] == pytest.approx(actual, rel=1e-3)


def test_a_month_does_not_see_itself_and_series_keep_apart(spark):
    series = [("a", d, 10.0) for d in DAYS] + [("b", d, 99.0) for d in DAYS if (d.year, d.month) not in ((1997, 3), (1997, 5))]
    base = predicted(cells_of(spark, series))
    moved = predicted(cells_of(spark, [(k, d, v * (5 if (d.year, d.month) == (1997, 12) else 1)) for k, d, v in series]))
    assert base["a", dt.date(1997, 12, 1)] == pytest.approx(310.0, rel=1e-3) and base == pytest.approx(moved)
    assert ("b", dt.date(1997, 3, 1)) not in base  # a month without sales stays without a row, but counts as zero behind
    assert base["b", dt.date(1997, 4, 1)] < 99.0 * 30


def test_short_and_empty_series(spark):
    assert set(predicted(cells_of(spark, [("a", DAYS[0], 1.0), ("a", DAYS[40], 1.0)])).values()) == {None}
    assert predicted(cells_of(spark, [])) == {}


def test_a_cell_inside_its_band_is_immaterial(spark):
    cells = spark.createDataFrame([("net_revenue", 5.0, 50.0, b) for b in (True, False, None)], "kpi string, delta double, delta_pct double, band_breach boolean")
    found = gates.materiality_gate(cells, config.kpi_table(spark)).collect()
    assert {r["band_breach"]: (r["material"], r["outcome"]) for r in found} == {
        True: (True, None), False: (False, "IMMATERIAL"), None: (True, None)}
    assert gates.materiality_gate(cells.drop("band_breach"), config.kpi_table(spark)).where("material").count() == 3


def test_a_case_opens_for_those_who_may_see_it(spark):
    cells = spark.createDataFrame([(k, g) for k in ("net_revenue", "unknown") for g in ("ASIA", "EUROPE")], "kpi string, region string")
    seen = lambda persona: {tuple(r) for r in cells.where(gates.may_see(F.col("kpi"), F.col("region"), persona, "ASIA")).collect()}
    assert seen("regional_manager") == {("net_revenue", "ASIA")}
    assert seen("cxo") == {("net_revenue", "ASIA"), ("net_revenue", "EUROPE")}
    assert seen("nobody") == set()
