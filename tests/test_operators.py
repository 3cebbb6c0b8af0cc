"""Hand-computed frames and metamorphic checks of single operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.operators import actions, causal, confidence, conform, evidence, gates, kpis, movement, quality, requests, whatif
from kpisleuth.sources import standins, tables

D = dt.date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- configuration ------------------------------------------------------------
def test_weights_and_references():
    assert sum(config.COMPONENT_WEIGHTS.values()) == pytest.approx(1.0)
    for name, h in config.HYPOTHESES.items():
        assert name not in h["confounders"]
        assert set(h["confounders"]) <= set(config.HYPOTHESES)
        assert not set(h["available"]) & set(config.SOURCES_NOT_HELD)
        assert set(h["tests"]) <= set(config.TESTS)
    for book in config.PLAYBOOKS.values():
        assert book["curve"] in config.RECOVERY_CURVES
        assert book["driver"] in config.HYPOTHESES
        assert max(book["checkpoints"]) <= book["horizon_weeks"]
    assert all(c["p25"] <= c["p75"] <= 1.0 for c in config.RECOVERY_CURVES.values())
    assert all(config.DEFAULT_PERSONA in policies for policies in config.ACCESS.values())


def test_competitor_action_is_unverifiable(spark):
    known = causal.missing_sources(config.hypothesis_table(spark))
    assert rows(known.where("NOT verifiable"), "hypothesis", "missing") == [
        ("competitor_action", ["competitor_pricing", "competitor_footfall"])
    ]


# --- KPIs -----------------------------------------------------------------------
def test_conversion_counts_visits_once(spark):
    """Three bill lines on one day do not triple the day's visits, and a day
    with visits but no sale stays in the denominator."""
    day, quiet = D(2025, 10, 1), D(2025, 10, 2)
    sales = spark.createDataFrame(
        [(i, 10, day, "RETAIL", "SALE") for i in (1, 1, 2)],
        "txn_id long, store_id long, txn_date date, channel string, txn_type string",
    )
    footfall = spark.createDataFrame(
        [(10, day, 20, True), (10, quiet, 20, True), (11, day, None, False)],
        "store_id long, footfall_date date, footfall long, counter_installed boolean",
    )
    stores = spark.createDataFrame([(10, "East"), (11, "East")], "store_id long, region string")
    got = kpis.conversion_rate(sales, footfall, stores, "monthly").collect()
    assert [(r["bills"], r["visits"], r["conversion_rate_pt"]) for r in got] == [(2, 40, 5.0)]


def test_grains_are_refused():
    with pytest.raises(ValueError):
        kpis.check_grain("qcomm_fulfilment_rate", "monthly")
    with pytest.raises(ValueError):
        kpis.check_grain("net_revenue", "hourly")


def test_daily_rolls_up_to_monthly(spark):
    folder = "/root/testdata/sf0.001"
    sales, stores = standins.sales(spark, folder), standins.stores(spark, folder)
    daily = kpis.kpis_at_grain(["net_revenue"], sales, stores, "daily").groupBy(
        "region", F.date_trunc("month", "period").alias("m")).agg(F.sum("value").alias("v")).toPandas()
    monthly = kpis.kpis_at_grain(["net_revenue"], sales, stores, "monthly").toPandas()
    assert daily["v"].sum() == pytest.approx(monthly["value"].sum(), abs=1e-2)
    assert len(daily) == len(monthly)


def test_row_policy_and_mask(spark):
    df = spark.createDataFrame([("East", 1, 5, 2.0), ("West", 2, 6, 3.0)], "region string, store_id int, staff_headcount int, margin_pct double")
    assert kpis.apply_row_policy(df, "net_revenue").count() == 2
    own = kpis.apply_row_policy(df, "net_revenue", "regional_manager", {"user_region": "West"})
    assert rows(own, "store_id") == [(2,)]
    hidden = kpis.mask(df, "net_revenue", "store_manager")
    assert hidden.schema["staff_headcount"].dataType == df.schema["staff_headcount"].dataType
    assert rows(hidden, "store_id", "staff_headcount") == [(1, None), (2, None)]
    with pytest.raises(PermissionError):
        kpis.apply_row_policy(df, "net_revenue", "stranger")
    with pytest.raises(PermissionError):
        kpis.apply_row_policy(df, "net_revenue", "store_manager")


def test_returns_move_to_the_posted_period(spark):
    sales = spark.createDataFrame(
        [(1, D(2025, 10, 31), D(2025, 11, 2), 100.0, 10.0, 9.0, 90.0)],
        "store_id int, txn_date date, posted_date date, gross_amount double, discount_amount double, tax_amount double, returns_amount double",
    )
    got = rows(conform.net_by_processed_period(sales, "monthly", ["store_id"]), "period", "sold_cr", "returned_cr")
    assert got == [(D(2025, 10, 1), round(81.0 / 1e7, 6), 0.0), (D(2025, 11, 1), 0.0, round(90.0 / 1e7, 6))]


# --- movement ---------------------------------------------------------------------
def case_cells(spark):
    return spark.createDataFrame(
        [("West", D(2025, 10, 1), 83.70, 83.70), ("West", D(2025, 11, 1), 76.92, 83.70 * 0.968),
         ("South", D(2025, 8, 1), 50.0, 50.0), ("South", D(2025, 9, 1), 50.0, 56.0), ("South", D(2025, 11, 1), 50.0, 50.0)],
        "region string, period date, value double, expected double",
    )


def test_decomposition_identity(spark):
    west = movement.decompose(case_cells(spark), ["region"]).where("region = 'West' AND previous IS NOT NULL").first()
    assert west["headline_pt"] == pytest.approx(-8.1, abs=0.05)
    assert west["calendar_pt"] == pytest.approx(-3.2, abs=0.05)
    assert west["residual_pt"] == pytest.approx(-4.9, abs=0.05)
    assert west["calendar_value"] + west["residual_value"] == pytest.approx(west["value"] - west["previous"], abs=0.02)


def test_flat_month_that_should_have_risen(spark):
    south = movement.growth_residual(case_cells(spark), ["region"]).where("region = 'South' AND period = '2025-09-01'").first()
    assert south["growth_residual_pt"] == pytest.approx(-12.0)


def test_gap_breaks_movement(spark):
    moved = movement.movement(case_cells(spark), ["region"]).where("region = 'South' AND period = '2025-11-01'").first()
    assert moved["previous"] is None


def test_price_mix_sums_to_change(spark):
    parts = spark.createDataFrame(
        [("E", "a", D(2025, 1, 1), 100.0, 10.0), ("E", "b", D(2025, 1, 1), 400.0, 20.0),
         ("E", "a", D(2025, 2, 1), 240.0, 20.0), ("E", "b", D(2025, 2, 1), 200.0, 10.0)],
        "region string, item string, period date, net double, units double",
    )
    row = movement.price_mix(parts, ["region"], "item").first()
    assert row["price_effect"] == pytest.approx((12 - 10) / 3)
    assert row["price_effect"] + row["mix_effect"] == pytest.approx(440 / 30 - 500 / 30)


def test_seasonal_recovers_weekday_effect(spark):
    days = pd.date_range("2025-01-06", periods=70)
    frame = pd.DataFrame({"k": "s", "date": days.date, "value": 100.0 + np.where(days.dayofweek >= 5, 7.0, 0.0)})
    got = movement.seasonal_baseline(spark.createDataFrame(frame, "k string, date date, value double"), ["k"]).toPandas()
    inner = got.dropna(subset=["baseline"])
    assert np.allclose(inner["residual"], 0.0, atol=1e-9)
    smooth = movement.loess_baseline(spark.createDataFrame(frame, "k string, date date, value double"), ["k"], "k string").toPandas()
    assert np.abs(smooth["residual"]).max() < 1e-6


def test_calendar_regression_recovers_effects(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(400) < 0.3, rng.random(400) < 0.2
    frame = pd.DataFrame({"k": 1, "a": a, "b": b, "value": 5.0 + 2.0 * a - 3.0 * b})
    row = movement.calendar_regression(spark.createDataFrame(frame), ["k"], "k long", ["a", "b"]).first()
    assert (row["b_intercept"], row["b_a"], row["b_b"]) == pytest.approx((5.0, 2.0, -3.0))


def test_festival_peak_and_hangover(spark):
    windows = config.festival_window_table(spark, {"Diwali": [(D(2025, 10, 14), D(2025, 10, 23))]})
    intensity = config.festival_intensity_table(spark)
    days = spark.sql("SELECT explode(sequence(DATE'2025-10-01', DATE'2025-11-05')) AS date")
    west = movement.festival_factor(days, windows, intensity, 0.5).where("region = 'West'").toPandas().set_index("date")["factor"]
    assert west.idxmax() in (D(2025, 10, 21), D(2025, 10, 22))
    assert west[D(2025, 10, 24)] < west[D(2025, 10, 30)] < 1.0
    assert west[D(2025, 10, 31)] == 1.0 and west[D(2025, 10, 13)] == 1.0


# --- gates ------------------------------------------------------------------------
def test_gates_fire_in_order(spark):
    cells = spark.createDataFrame(
        [(0.2, False, 7, 26, True, 0, 2), (0.0, False, 7, 26, True, 0, 2), (0.0, True, 7, 26, True, 0, 2),
         (0.0, True, 78, 26, False, 0, 2), (0.0, True, 78, 26, True, 1, 2), (0.0, True, 78, 26, True, 2, 2)],
        "missing_share double, material boolean, weeks_held int, min_history_weeks int, authorised boolean, run_length int, persistence_periods int",
    )
    assert [r["outcome"] for r in gates.gate_outcome(cells).collect()] == [
        "DATA_INCIDENT", "IMMATERIAL", "INSUFFICIENT_HISTORY", "NOT_AUTHORISED", "NOT_PERSISTENT", None
    ]


def test_materiality_uses_the_kpi_unit(spark):
    cells = spark.createDataFrame(
        [("net_revenue", -4.1, -4.9), ("net_revenue", -0.3, -4.9), ("conversion_rate", -1.2, -5.5), ("transactions", -900.0, -2.0),
         ("qcomm_fulfilment_rate", -5.0, -5.0)], "kpi string, delta double, delta_pct double")
    got = {(r["kpi"], r["delta"]): (r["material"], r["outcome"]) for r in gates.materiality_gate(cells, config.kpi_table(spark)).collect()}
    assert got[("net_revenue", -4.1)] == (True, None)
    assert got[("net_revenue", -0.3)] == (False, "IMMATERIAL")
    assert got[("conversion_rate", -1.2)] == (True, None)
    assert got[("transactions", -900.0)] == (False, "IMMATERIAL")
    assert got[("qcomm_fulfilment_rate", -5.0)] == (None, "MONITORING_ONLY")


def test_persistence_counts_consecutive(spark):
    cells = spark.createDataFrame([(1, n, b) for n, b in [(1, True), (2, True), (3, False), (4, True), (6, True)]], "k int, n int, breach boolean")
    got = gates.persistence_gate(cells, ["k"], F.lit(2), F.col("n"))
    assert rows(got, "n", "run_length", "outcome") == [
        (1, 1, "NOT_PERSISTENT"), (2, 2, None), (3, 0, None), (4, 1, "NOT_PERSISTENT"), (6, 1, "NOT_PERSISTENT")]


def test_week_masks_count_distinct_weeks(spark):
    days = spark.sql("SELECT 'k' AS k, explode(sequence(DATE'2024-12-20', DATE'2025-04-02', INTERVAL 2 DAY)) AS d")
    months = days.groupBy("k", F.date_trunc("month", "d").cast("date").alias("period")).agg(F.bit_or(gates.week_mask("d")).alias("m"))
    want = days.agg(F.countDistinct(F.date_trunc("week", "d"))).first()[0]
    assert gates.weeks_held(months, ["k"], "period", "m").first()["weeks_held"] == want


def test_case_signals_equal_the_separate_operators(spark):
    items = standins.evidence(spark, "/root/testdata/sf0.001")
    tiers = config.reliability_table(spark)
    both = {r["hypothesis"]: r for r in evidence.case_signals(items, tiers, ["hypothesis"]).collect()}
    for r in evidence.evidence_weight(items, tiers).collect():
        assert both[r["hypothesis"]]["low_share"] == pytest.approx(r["low_share"], abs=1e-6)
    for r in evidence.contradictions(items).collect():
        assert both[r["hypothesis"]]["contradictory"] == r["contradictory"]


def test_completeness_counts_absent_days(spark):
    feeds = spark.createDataFrame([("pos", D(2025, 1, 1), s) for s in range(4)] + [("pos", D(2025, 1, 3), 0), ("wms", D(2025, 1, 2), 1)],
                                  "feed string, feed_date date, store_id int")
    got = dict(((f, d), s) for f, d, s in rows(gates.completeness_gate(feeds), "feed", "feed_date", "missing_share"))
    assert got[("pos", D(2025, 1, 1))] == 0.0 and got[("pos", D(2025, 1, 2))] == 1.0 and got[("pos", D(2025, 1, 3))] == 0.75
    assert len(got) == 6


def test_freshness_credit_ramp(spark):
    df = spark.createDataFrame([(0.0,), (24.0,), (60.0,), (96.0,), (120.0,)], "age double")
    got = [r[0] for r in df.select(gates.freshness_credit(F.col("age"), F.lit(24.0), F.lit(96.0))).collect()]
    assert got == [1.0, 1.0, 0.5, 0.0, 0.0]


# --- evidence and causal tests -------------------------------------------------------
def test_concordance_equals_pair_enumeration(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"hypothesis": "h", "kind": rng.choice(["structured_query", "store_note"], 60), "sign": rng.choice([-1, 0, 1], 60)})
    s = frame[(frame.kind == "structured_query") & (frame.sign != 0)].sign.to_numpy()
    u = frame[(frame.kind == "store_note") & (frame.sign != 0)].sign.to_numpy()
    row = evidence.concordance(spark.createDataFrame(frame)).first()
    assert row["pairs"] == len(s) * len(u)
    assert row["concordance"] == pytest.approx((s[:, None] == u[None, :]).mean(), abs=1e-6)


def test_onset_finds_the_step(spark):
    values = [10.0] * 12 + [6.0] * 8
    frame = pd.DataFrame({"k": "a", "d": [D(2025, 1, 6) + dt.timedelta(weeks=i) for i in range(20)], "value": values})
    series = spark.createDataFrame(frame, "k string, d date, value double")
    assert causal.onset(series, ["k"], "d").first()["onset"] == D(2025, 1, 6) + dt.timedelta(weeks=12)
    noisy = frame.assign(value=frame["value"] + np.tile([0.1, -0.1], 10))
    cuts = causal.onsets(spark.createDataFrame(noisy, "k string, d date, value double"), ["k"], "k string", "d").collect()
    assert [c["position"] for c in cuts] == [12]


def test_did_recovers_injected_effect(spark):
    rng = np.random.default_rng(4)
    out = []
    for unit in range(60):
        treated, control = unit < 20, 20 <= unit < 40
        base = rng.uniform(80, 120)
        for day in range(-28, 28):
            lift = 1.05 * (0.82 if treated else 1.0) if day >= 0 else 1.0
            out.append((unit, "W", treated, control, D(2025, 11, 4) + dt.timedelta(days=day), base * lift))
    panel = spark.createDataFrame(out, "unit int, region string, is_treated boolean, is_control boolean, day date, revenue double")
    units = causal.unit_growth(panel, ["unit", "region", "is_treated", "is_control"], "day", "revenue", "2025-11-04", 28)
    assert causal.did(units, ["region"]).first()["did_pt"] == pytest.approx(100 * 1.05 * -0.18, abs=1e-6)
    scope = causal.did_region(units, ["region"]).first()
    totals = units.groupBy().agg(F.sum(F.when(F.col("is_treated"), F.col("pre"))), F.sum("pre")).first()
    assert scope["did_pt"] == pytest.approx(-100 * 1.05 * 0.18 * totals[0] / totals[1], abs=1e-6)
    trend = causal.parallel_trends(panel, ["region"], "day", "revenue", "2025-11-04").first()
    assert trend["slope"] == pytest.approx(0.0, abs=1e-9)


def test_welch_against_formula(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(1, 2, 15), rng.normal(0, 1, 22)
    frame = pd.DataFrame({"k": 1, "flag": [True] * 15 + [False] * 22, "v": np.concatenate([a, b])})
    row = causal.welch(spark.createDataFrame(frame), ["k"], "flag", "v").first()
    va, vb = a.var(ddof=1) / 15, b.var(ddof=1) / 22
    assert row["t"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb))
    assert row["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 14 + vb**2 / 21))


def test_confounder_screen(spark):
    df = spark.createDataFrame([(1, "a", ["b", "c"], True, True), (1, "b", ["a"], True, False), (1, "c", ["a"], False, False), (2, "a", ["b"], True, True)],
                               "case int, hypothesis string, confounders array<string>, live boolean, tested boolean")
    got = causal.confounder_screen(df, ["case"]).where("live")
    assert rows(got, "case", "hypothesis", "unresolved", "screen_failed") == [(1, "a", ["b"], True), (1, "b", [], False), (2, "a", [], False)]


def test_attribution_never_exceeds_residual(spark):
    cells = spark.createDataFrame([(-4.9, -4.3, 83.7), (-4.9, -9.0, 83.7), (-4.9, 3.0, 83.7)], "residual_pt double, did_pt double, previous double")
    got = causal.attribute(cells, 0.9).collect()
    assert got[0]["attributed_pt"] == pytest.approx(-3.87)
    assert got[0]["unattributed_value"] == pytest.approx(-0.86, abs=0.02)
    assert got[1]["attributed_share"] == 1.0 and got[2]["attributed_share"] == 0.0


# --- confidence and actions ------------------------------------------------------------
def test_caps_take_the_lowest_ceiling(spark):
    df = spark.createDataFrame([(0.8876, False, False, False, False), (0.9, True, True, False, False), (0.3, False, True, False, False), (0.9, False, False, True, True)],
                               "raw double, confounder_screen_failed boolean, required_source_missing boolean, temporal_precedence_failed boolean, low_reliability_dominated boolean")
    got = confidence.apply_caps(df).collect()
    assert [r["after_caps"] for r in got] == [0.8876, 0.45, 0.3, 0.0]
    assert got[1]["forced_triggers"] == ["T3"] and got[3]["eliminated"]


def test_verdict_table(spark):
    df = spark.createDataFrame(
        [(["T3"], 0.9, 0.9, False), ([], 0.79, 0.84, True), ([], 0.79, 0.84, False), ([], 0.5, 0.65, False), ([], 0.2, 0.9, False), ([], 0.5, 0.5, False)],
        "triggers_fired array<string>, coverage double, confidence double, unverifiable_above_materiality boolean")
    got = confidence.verdict(df).collect()
    assert [r["verdict"] for r in got] == ["INSUFFICIENT_EVIDENCE", "PARTIALLY_EXPLAINED", "EXPLAINED", "PARTIALLY_EXPLAINED", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"]
    assert got[1]["reason_code"] == "live_unverifiable_above_materiality"


def test_near_tie_is_inclusive(spark):
    df = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.7), (2, "a", 0.8), (2, "b", 0.69), (3, "a", 0.5)], "case int, hypothesis string, c double")
    assert rows(confidence.leading(df, ["case"], "c"), "case", "hypothesis", "near_tie") == [(1, "a", True), (2, "a", False), (3, "a", False)]


def test_abstaining_case_fires_its_triggers(spark):
    case = spark.createDataFrame([(True, 0.9, False, True, False, 0.2, 0.58, 12, 10.0)],
                                 "hard_gates_passed boolean, attributed_share double, verifiable boolean, near_tie boolean, contradictory boolean, "
                                 "low_share double, case_type_accuracy double, closed_cases int, staleness_hours double")
    assert confidence.triggers(case).first()["triggers_fired"] == ["T3", "T4", "T7"]


def test_action_arithmetic(spark):
    case = spark.createDataFrame([("stock_out", 34, 26, 140, 0.04, 1e7, 3.24e7), ("staffing_shortfall", 34, 26, 10, 0.04, 1e7, 3.24e7),
                                  ("price_increase", 34, 26, 10, 0.04, 1e7, 3.24e7), ("competitor_action", 34, 26, 10, 0.04, 1e7, 3.24e7)],
                                 "driver string, treated_stores int, uninstrumented_stores int, affected_stores int, depth double, affected_revenue double, attributable_loss double")
    got = {r["playbook"]: r for r in actions.roi(actions.recovery_range(actions.action_cost(actions.with_playbook(case, config.playbook_table(spark))))).collect()}
    stock = got["availability_recovery"]
    assert stock["cost_inr"] == pytest.approx(18.02e5)
    assert stock["recovery_low"] / 1e7 == pytest.approx(2.3, abs=0.02) and stock["recovery_high"] / 1e7 == pytest.approx(3.1, abs=0.02)
    assert stock["roi_low"] == pytest.approx(13, abs=0.5) and stock["roi_high"] == pytest.approx(17, abs=0.5)
    assert got["staffing_uplift"]["cost_inr"] == 24000 * 10 * 4
    assert got["price_correction"]["cost_inr"] == pytest.approx(4e5)
    assert got["competitor_intelligence"]["roi_low"] == 0.0


def test_revenue_equivalent(spark):
    df = spark.createDataFrame([(-1.2, 22.0, 34.5)], "residual_pt double, conversion_before_pt double, revenue double")
    assert kpis.revenue_equivalent(df).first()["revenue_equivalent"] == pytest.approx(1.88, abs=0.01)


# --- text ------------------------------------------------------------------------------
def test_fingerprint_of_the_recorded_request(spark):
    df = spark.createDataFrame([(1, "why did west revenue fall last month")], "id int, text string")
    request = requests.message_request(df, "id", "classify", "text", config.CLASSIFY_SYSTEM, 16)
    assert requests.fingerprint(request).first()["fingerprint"] == "ee434eb6cc7ddb50b6219ee1197682c86cf8a01c1fa38ceffe576302e57949e3"


def test_copies_are_looked_up_once(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, fingerprint string")
    cache = spark.createDataFrame([("x", "answer")], "fingerprint string, response string")
    assert rows(requests.resolve(asked, cache), "id", "hit") == [(1, True), (2, True), (3, False)]
    assert rows(requests.misses(asked, cache), "fingerprint", "waiting") == [("y", 1)]


def test_fingerprint_covers_every_turn(spark):
    from kpisleuth.operators import requests

    def mark(*texts, **options):
        turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(texts)], "conv_id long, turn long, role string, text string")
        return requests.fingerprint(requests.conversation_requests(turns, "classify", **options)).first()["fingerprint"]

    base = mark(("user", "a"), ("assistant", "b"))
    others = [mark(("user", "b"), ("assistant", "a")), mark(("user", "a"), ("assistant", None)), mark(("user", "a"), ("user", "b")),
              mark(("user", "a")), mark(("user", "a"), ("assistant", "b"), max_tokens=16), mark(("user", "a"), ("assistant", "b"), system="s")]
    assert len({base, *others}) == 7


# --- what-if and quality ------------------------------------------------------------------
def test_elasticity_is_recovered(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": 1, "revenue": rng.uniform(50, 150, 200), "availability": rng.uniform(0.6, 0.94, 200)})
    panel = whatif.lost_sales(spark.createDataFrame(frame), 1.7, 0.61, 0.94).withColumn("observed_revenue", F.col("revenue") - F.col("lost"))
    effects = panel.groupBy("k").agg((1 - F.sum("observed_revenue") / F.sum("revenue")).alias("reduction"))
    assert whatif.fit_elasticity(panel, effects, ["k"], 0.61, 0.94).first()["beta"] == pytest.approx(1.7, abs=1e-9)


def test_no_gap_no_effect(spark):
    frame = pd.DataFrame({"k": 1, "revenue": [100.0, 80.0], "availability": [0.94, 0.7], "is_treated": [False, True], "after_onset": [True, True]})
    row = whatif.neutrality(spark.createDataFrame(frame), ["k"], 1.26, 0.61, 0.94).first()
    assert row["max_neutral_change"] == 0.0 and row["max_exempt_change"] == 0.0 and row["max_treated_change"] > 1.0


def test_digest_ignores_order_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert quality.digest(a).first() == quality.digest(a.orderBy(F.desc("a")).select("b", "a")).first()
    assert quality.digest(a).first() != quality.digest(a.dropDuplicates()).first()


def test_export_reads_back_in_order(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.23456), (1, 2.0)], "k int, v double")
    path = tables.export_canonical(df, ["k"], str(tmp_path / "out"))
    back = spark.read.schema("k int, v double").option("header", True).csv(path)
    assert rows(back, "k", "v") == [(1, 2.0), (2, 1.2346)]


def test_guards(spark):
    df = spark.createDataFrame([(1, None, True, 9.0), (2, 5, False, 9.0)], "id int, footfall int, counter boolean, price double")
    row = quality.schema_guard(df, ["price"], "footfall", "counter").first()
    assert (row["forbidden_present"], row["null_but_flagged"], row["value_but_unflagged"]) == ("price", 1, 1)
    weights = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.9)], "g string, w double")
    assert rows(quality.weights_sum(weights, ["g"], "w"), "g") == [("b",)]


def test_conversion_leaves_wholesale_and_transfers_out(spark):
    """One retail, one wholesale and one transfer bill on ten visits: 10 in 100."""
    import datetime as dt

    from kpisleuth.operators import kpis

    day = dt.date(2025, 1, 6)
    sales = spark.createDataFrame([(1, 1, day, "RETAIL", "SALE"), (2, 1, day, "B2B", "SALE"), (3, 1, day, "RETAIL", "TRANSFER")],
                                  "txn_id long, store_id long, txn_date date, channel string, txn_type string")
    visits = spark.createDataFrame([(1, day, 10, True)], "store_id long, footfall_date date, footfall int, counter_installed boolean")
    stores = spark.createDataFrame([(1, "R")], "store_id long, region string")
    assert kpis.conversion_rate(sales, visits, stores, "weekly").first()["conversion_rate_pt"] == 10.0


def test_total_outage_shows(spark):
    """Rows on the 1st and the 3rd: nothing of the feed arrived on the 2nd."""
    import datetime as dt

    from kpisleuth.operators import gates

    feeds = spark.createDataFrame([("pos", dt.date(2025, 1, d), s, 6.0) for d in (1, 3) for s in (1, 2)],
                                  "feed string, feed_date date, store_id long, amount double")
    got = {r["feed_date"].day: r["apparent_movement_pct"] for r in gates.incident_impact(feeds).collect()}
    assert got == {1: 0.0, 2: -100.0, 3: 0.0}


def test_closed_days_include_the_last(spark, tmp_path):
    from kpisleuth.plans import all_queries

    rows = all_queries()["x1_stream_kpi"].run(spark, "/root/testdata/sf0.001")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert rows.agg(F.sum("items")).first()[0] == events.count()


def store_panel(effect):
    """Forty stores: the cause hits half of them by varying doses; ``effect`` of the dose reaches the KPI."""
    import random

    rng = random.Random(5)
    rows = []
    for store in range(40):
        dose = -0.3 - 0.4 * rng.random() if store % 2 else 0.1 * rng.random()
        earlier = rng.gauss(0.0, 0.03)
        growth = effect * dose + rng.gauss(0.0, 0.03)
        rows.append(("R", store, dose, growth, earlier, dose < 0, 100.0 * (1 + growth), 100.0))
    return rows


@pytest.mark.parametrize("effect", [1.0, 0.0])
def test_an_injected_effect_passes_the_store_tests_and_its_removal_does_not(spark, effect):
    from kpisleuth.functions.stats import p_student_t
    from kpisleuth.operators import causal

    frame = spark.createDataFrame(store_panel(effect), "region string, store_id long, driver double, growth double, growth_before double, "
                                  "exposed boolean, now double, before double")
    row = causal.store_tests(frame, ["region"]).withColumn("did_p", p_student_t("did_t", "did_df")).withColumn(
        "pre_p", p_student_t("pre_t", "pre_df")).withColumn("spec_p", p_student_t("spec_t", "spec_df")).first()
    assert row["stores"] == 40 and row["pre_p"] > 0.05
    passed = [row["dose_r"] >= 0.30, row["spec_p"] <= 0.05 and row["spec_t"] < 0, row["did_p"] <= 0.01 and row["did_t"] < 0]
    assert passed == [effect == 1.0] * 3
    exposed = [r for r in store_panel(effect) if r[5]]
    control = sum(r[3] for r in store_panel(effect) if not r[5]) / 20
    assert row["did_pt"] == pytest.approx(100.0 * sum(r[6] - r[7] * (1 + control) for r in exposed) / 4000.0)


def test_a_case_of_one_store_has_no_tests(spark):
    from kpisleuth.operators import causal

    row = causal.store_tests(spark.createDataFrame(store_panel(1.0)[:1], "region string, store_id long, driver double, growth double, growth_before double, "
                                                   "exposed boolean, now double, before double"), ["region"]).first()
    assert row["dose_r"] is None and row["spec_t"] is None and row["did_t"] is None


def test_contribution_of_every_pair_of_years(spark):
    """A year whose forerunner is missing has no pair; a member of one year alone counts in full."""
    from kpisleuth.operators import kpis

    rows = [(1994, "a", "x", 1e7), (1995, "a", "x", 3e7), (1995, "b", "x", 2e7), (1996, "b", "y", 1e7), (1998, "a", "x", 9e7)]
    frame = spark.createDataFrame(rows, "year int, store_id string, sku string, value double")
    found = {(r["year"], r["dimension"], r["member"]): (r["delta_cr"], r["share_of_delta"])
             for r in kpis.contribution_by_year(frame, ["store_id", "sku"]).collect()}
    assert found == {
        (1995, "store_id", "a"): (2.0, 0.5), (1995, "store_id", "b"): (2.0, 0.5), (1995, "sku", "x"): (4.0, 1.0),
        (1996, "store_id", "a"): (-3.0, 0.75), (1996, "store_id", "b"): (-1.0, 0.25), (1996, "sku", "x"): (-5.0, 1.25), (1996, "sku", "y"): (1.0, -0.25)}


def test_telemetry_levels_tokens_and_missing_values(spark):
    calls = spark.createDataFrame([
        ("VERDICT", "large", "c1", 100.0, 1.0, 10, 1), ("VERDICT", "large", "c1", 300.0, 2.0, 20, None),
        ("VERDICT", "small", "c2", 50.0, 0.5, 5, None), ("GATHER", None, "c1", None, 0.0, None, None),
    ], "stage string, model string, case_id string, duration_ms double, cost double, input_tokens long, output_tokens long")
    rows = requests.telemetry(calls, ["stage", "model", "case_id"], ["input_tokens", "output_tokens"]).collect()
    got = {tuple(r[:4]): tuple(r[4:]) for r in rows}
    assert got[0, None, None, None] == (4, 3.5, 35, 1, 280.0)
    assert got[1, "VERDICT", None, None] == (3, 3.5, 35, 1, 280.0)
    assert got[2, "VERDICT", "large", None] == (2, 3.0, 30, 1, 290.0)
    assert got[3, "VERDICT", "small", "c2"] == (1, 0.5, 5, None, 50.0)
    assert got[1, "GATHER", None, None] == got[2, "GATHER", None, None] == (1, 0.0, None, None, None)
    assert len(rows) == 1 + 2 + 3 + 3
