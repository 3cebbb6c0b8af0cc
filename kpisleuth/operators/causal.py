"""The causal tests: onset, precedence, sufficiency, dose-response,
specificity, difference-in-differences, confounders and attribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import ratio, rounded, spread_by
from kpisleuth.functions.stats import welch_df, welch_t


LEAST_NOISE = 1e-6  # series come rounded to six places


def onset(series: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Single mean-shift changepoint: the split with the largest reduction in
    squared error, from running sums.  ``series`` has one row per period."""
    run = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    n1, s1 = F.count("value").over(run), F.sum("value").over(run)
    n, s = F.count("value").over(whole), F.sum("value").over(whole)
    n2, s2 = n - n1, s - s1
    gain = F.when(n1 > 0, n1 * n2 / n * F.pow(s1 / n1 - s2 / n2, 2))
    scored = series.where(F.col("value").isNotNull()).withColumn("gain", gain).withColumn(
        "shift", F.when(n1 > 0, s2 / n2 - s1 / n1)
    )
    best = F.max_by(F.struct(F.col(day).alias("onset"), "gain", "shift"),
                    F.struct("gain", (-F.unix_date(day)).alias("earliest")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.onset", "b.gain", "b.shift")


def _changepoints(values: np.ndarray, penalty: float, min_size: int = 2) -> list[int]:
    """Penalised optimal partitioning of squared error, with pruning.

    A start that loses to a cut at ``end`` can never win again once a segment may
    follow that cut, which is ``min_size`` steps later; until then it stays.
    """
    n = len(values)
    c1 = np.concatenate([[0.0], np.cumsum(values)])
    c2 = np.concatenate([[0.0], np.cumsum(values**2)])
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    previous = np.zeros(n + 1, dtype=int)
    starts, leaves = np.array([0]), np.array([n + 1])  # in ascending order; when each may go
    for end in range(min_size, n + 1):
        stay = leaves > end
        starts, leaves = starts[stay], leaves[stay]
        totals = best[starts] + (c2[end] - c2[starts] - (c1[end] - c1[starts]) ** 2 / (end - starts))
        k = int(totals.argmin())
        best[end], previous[end] = totals[k] + penalty, starts[k]
        leaves = np.where(totals > best[end], np.minimum(leaves, end + min_size), leaves)
        starts, leaves = np.append(starts, end - min_size + 1), np.append(leaves, n + 1)
    cuts, end = [], n
    while end > 0:
        end = previous[end]
        if end > 0:
            cuts.append(int(end))
    return sorted(cuts)


def onsets(series: DataFrame, keys: list[str], key_schema: str, day: str, penalty_scale: float = 3.0) -> DataFrame:
    """All changepoints of each series.

    One group is one series of periods (bounded by the calendar), so groups are
    short arrays; the number of series is what scales out.
    """
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values(day, kind="stable").reset_index(drop=True)
        values = pdf["value"].to_numpy(dtype=float)
        if len(values) < 4:
            return pd.DataFrame(columns=[*keys, "onset", "position", "shift"])
        noise = np.median(np.abs(np.diff(values))) / 0.9539
        cuts = _changepoints(values, penalty_scale * max(noise, LEAST_NOISE) ** 2 * np.log(len(values)))
        edges = [0, *cuts, len(values)]
        rows = []
        for i, cut in enumerate(cuts):
            before, after = values[edges[i]:cut].mean(), values[cut:edges[i + 2]].mean()
            rows.append([*pdf.loc[0, keys], pdf.loc[cut, day], cut, after - before])
        return pd.DataFrame(rows, columns=[*keys, "onset", "position", "shift"])

    schema = f"{key_schema}, onset date, position int, shift double"
    return spread_by(series.select(*keys, day, "value"), keys).groupBy(*keys).applyInPandas(find, schema)


def precedence(causes: DataFrame, effects: DataFrame, keys: list[str], max_lag_days: int = config.PRECEDENCE_MAX_LAG_DAYS) -> DataFrame:
    """For every change of the effect, the last change of the cause up to that day
    or the next one; passes when it came before, at most ``max_lag_days`` earlier.

    Changes of one series are few, so they meet on the series' key.
    """
    lag = F.datediff("effect_onset", "cause_onset")
    met = effects.select(*keys, F.col("onset").alias("effect_onset")).join(
        causes.select(*keys, F.col("onset").alias("cause_onset")), keys, "left")
    # The latest cause at or before the effect, else the earliest after it.
    nearest = F.min_by("cause_onset", F.when(lag >= 0, lag).otherwise(F.lit(1 << 20) - lag))
    return met.groupBy(*keys, "effect_onset").agg(nearest.alias("cause_onset")).withColumn("lag_days", lag).withColumn(
        "passed", F.coalesce((F.col("lag_days") > 0) & (F.col("lag_days") <= max_lag_days), F.lit(False)))


def sufficiency(hypotheses: DataFrame) -> DataFrame:
    """Modelled largest impact (volume share x elasticity x driver change, in
    points) against the required share of the residual."""
    impact = 100.0 * F.col("volume_share") * F.col("elasticity") * F.abs("driver_change")
    share = ratio(F.col("max_impact_pt"), F.abs("residual_pt"))
    return (
        hypotheses.withColumn("max_impact_pt", impact)
        .withColumn("impact_share", share)
        .withColumn("passed", F.col("impact_share") >= config.SUFFICIENCY_SHARE)
    )


def dose_response(panel: DataFrame, keys: list[str], dose: str, response: str) -> DataFrame:
    """OLS of store-level decline on store-level gap, by regression aggregates."""
    y, x = F.col(response), F.col(dose)
    return panel.groupBy(*keys).agg(
        F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"),
        F.corr(x, y).alias("r"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    ).withColumn("passed", F.col("r") >= config.DOSE_MIN_R)


def welch(panel: DataFrame, keys: list[str], flag: str, value: str) -> DataFrame:
    """Welch t of a value between units with and without the cause."""
    on, off = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    moments = panel.groupBy(*keys).agg(
        F.avg(on).alias("m1"), F.var_samp(on).alias("v1"), F.count(on).alias("n1"),
        F.avg(off).alias("m2"), F.var_samp(off).alias("v2"), F.count(off).alias("n2"),
    )
    m1, v1, n1, m2, v2, n2 = (F.col(c) for c in ("m1", "v1", "n1", "m2", "v2", "n2"))
    return moments.withColumn("t", welch_t(m1, v1, n1, m2, v2, n2)).withColumn(
        "df", welch_df(v1, n1, v2, n2)
    )


def weeks_from(day: Column, onset_day: str) -> Column:
    """Whole weeks relative to the onset; the week before it is -1."""
    return F.floor(F.datediff(day, F.lit(onset_day).cast("date")) / 7).cast("long")


def pre_weeks(panel: DataFrame, day: str, onset_day: str) -> DataFrame:
    """Rows in the pre-trend weeks, numbered; the date filter reaches the scan."""
    onset_date = F.lit(onset_day).cast("date")
    return panel.where(
        (F.col(day) >= F.date_sub(onset_date, 7 * config.PRETREND_WEEKS)) & (F.col(day) < onset_date)
    ).withColumn("week", weeks_from(F.col(day), onset_day))


def pre_trend(panel: DataFrame, unit: str, day: str, value: str, onset_day: str) -> DataFrame:
    """Slope of weekly value over the eight weeks before onset, per unit."""
    weekly = pre_weeks(panel, day, onset_day).groupBy(unit, "week").agg(F.sum(value).alias("value"))
    return weekly.groupBy(unit).agg(
        F.count(F.lit(1)).alias("weeks"), F.regr_slope(F.col("value"), F.col("week").cast("double")).alias("slope")
    )


def parallel_trends(panel: DataFrame, keys: list[str], day: str, value: str, onset_day: str) -> DataFrame:
    """Trend of log(treated / control) over the pre-weeks, with its t and df."""
    weekly = pre_weeks(panel, day, onset_day).groupBy(*keys, "week").agg(
        F.sum(F.when(F.col("is_treated"), F.col(value))).alias("treated"),
        F.sum(F.when(F.col("is_control"), F.col(value))).alias("control"),
    )
    y = F.when((F.col("treated") > 0) & (F.col("control") > 0), F.ln(F.col("treated") / F.col("control")))
    x = F.col("week").cast("double")
    fit = weekly.withColumn("y", y).where(F.col("y").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.regr_slope(F.col("y"), x).alias("slope"),
        F.regr_r2(F.col("y"), x).alias("r2"),
    )
    df = F.col("weeks") - 2
    size = F.sqrt(ratio(F.col("r2") * df, 1.0 - F.col("r2")))
    return fit.withColumn("df", df).withColumn("t", F.when(df > 0, F.signum("slope") * size))


def unit_growth(panel: DataFrame, keys: list[str], day: str, value: str, onset_day: str, window_days: int) -> DataFrame:
    """Pre and post totals and growth per unit, over equal windows around onset."""
    at = F.lit(onset_day).cast("date")
    near = panel.where((F.col(day) >= F.date_sub(at, window_days)) & (F.col(day) < F.date_add(at, window_days)))
    late = F.col(day) >= at
    return near.groupBy(*keys).agg(
        F.sum(F.when(~late, F.col(value))).alias("pre"), F.sum(F.when(late, F.col(value))).alias("post")
    ).withColumn("growth", ratio(F.col("post") - F.col("pre"), F.col("pre")))


def did(units: DataFrame, keys: list[str]) -> DataFrame:
    """Store-level difference-in-differences in points: mean growths of treated
    and control stores, with Welch's t and df."""
    treated, control = F.when(F.col("is_treated"), F.col("growth")), F.when(F.col("is_control"), F.col("growth"))
    moments = units.groupBy(*keys).agg(
        F.count_if(F.col("is_treated")).alias("treated"), F.count_if(F.col("is_control")).alias("controls"),
        F.avg(treated).alias("_m1"), F.var_samp(treated).alias("_v1"), F.count(treated).alias("_n1"),
        F.avg(control).alias("_m2"), F.var_samp(control).alias("_v2"), F.count(control).alias("_n2"),
    )
    m1, v1, n1, m2, v2, n2 = (F.col(c) for c in ("_m1", "_v1", "_n1", "_m2", "_v2", "_n2"))
    return moments.select(
        *keys, "treated", "controls", (100.0 * (m1 - m2)).alias("did_pt"),
        welch_t(m1, v1, n1, m2, v2, n2).alias("t"), welch_df(v1, n1, v2, n2).alias("df"),
    )


def did_region(units: DataFrame, keys: list[str]) -> DataFrame:
    """Counterfactual loss of the treated units over the scope's base revenue.

    The sum of post - pre x (1 + g) over treated units is linear in the mean
    control growth g, so the whole figure comes from one aggregate.
    """
    control = F.avg(F.when(F.col("is_control"), F.col("growth")))
    ready = F.col("is_treated") & F.col("growth").isNotNull()
    pre, post = F.sum(F.when(ready, F.col("pre"))), F.sum(F.when(ready, F.col("post")))
    return units.groupBy(*keys).agg(
        control.alias("control_growth"),
        (post - pre * (1.0 + control)).alias("loss"),
        F.sum("pre").alias("base"),
    ).withColumn("did_pt", 100.0 * ratio(F.col("loss"), F.col("base")))


def matched_did(pairs: DataFrame, keys: list[str], control: str = "candidate_id") -> DataFrame:
    """Difference-in-differences over matched pairs, in points.

    ``pairs``: keys, ``control``, and ``t_``/``c_`` columns ``growth`` and ``pre``,
    ``post`` of either side.  Stores sharing a control form one matched set, whose
    errors go together: the variance is that of the sums over sets, which is the
    paired variance where no control serves twice.  ``df`` is sets less one.
    ``loss`` is what the treated units fell short of their controls' growth.
    """
    gap = F.col("t_growth") - F.col("c_growth")
    whole = pairs.where(F.col("t_growth").isNotNull() & F.col("c_growth").isNotNull())
    sets = whole.groupBy(*keys, control).agg(
        F.sum(gap).alias("s"), F.count(F.lit(1)).alias("k"), F.sum("c_growth").alias("g"),
        F.sum(F.col("t_post") - F.col("t_pre") * (1.0 + F.col("c_growth"))).alias("loss"),
    )
    n, mean = F.sum("k"), F.sum("s") / F.sum("k")
    squares = F.sum(F.col("s") * F.col("s")) - 2.0 * mean * F.sum(F.col("s") * F.col("k")) + mean * mean * F.sum(F.col("k") * F.col("k"))
    found = sets.groupBy(*keys).agg(
        n.alias("matched"), F.count(F.lit(1)).alias("controls"), (100.0 * mean).alias("did_pt"), squares.alias("_q"),
        (F.sum("g") / n).alias("control_growth"), F.sum("loss").alias("loss"),
    )
    m, c = F.col("matched"), F.col("controls")
    error = F.when(c > 1, F.sqrt(F.greatest(F.col("_q"), F.lit(0.0)) * c / (c - 1)) / m)
    return found.withColumn("df", c - 1).withColumn("t", ratio(F.col("did_pt") / 100.0, error)).drop("_q")


def _measures() -> dict[str, Column]:
    """What each store test compares: growth, its change, and the growth before."""
    return {"spec": F.col("growth"), "did": F.col("growth") - F.col("growth_before"), "pre": F.col("growth_before")}


def _side_moments(panel: DataFrame, keys: list[str], sides: dict[str, Column]) -> DataFrame:
    """Mean, variance and count of every measure on every side, and revenue sums, in one aggregate."""
    moments = []
    for side, flag in sides.items():
        for name, value in _measures().items():
            own = F.when(flag, value)
            moments += [F.avg(own).alias(f"{name}_m{side}"), F.var_samp(own).alias(f"{name}_v{side}"),
                        F.count(own).alias(f"{name}_n{side}")]
        ready = flag & F.col("growth").isNotNull()
        moments += [F.sum(F.when(ready, F.col("before"))).alias(f"_pre{side}"), F.sum(F.when(ready, F.col("now"))).alias(f"_post{side}")]
    dose = F.when(F.col("growth").isNotNull(), F.col("driver"))
    # A cause that moved alike everywhere has no correlation.
    correlation = ratio(F.covar_pop(dose, F.col("growth")), F.stddev_pop(dose) * F.stddev_pop("growth"))
    return panel.groupBy(*keys).agg(
        F.count("growth").alias("stores"), correlation.alias("dose_r"), F.sum("before").alias("_base"), *moments,
    )


def _side_tests(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Tests of side 1 (the cause) against side 2 (the controls)."""
    out = moments
    for name in _measures():
        sides = [F.col(f"{name}_{part}{side}") for side in "12" for part in "mvn"]
        m1, v1, n1, m2, v2, n2 = sides
        out = out.withColumn(f"{name}_t", welch_t(*sides)).withColumn(f"{name}_df", welch_df(v1, n1, v2, n2))
    loss = F.col("_post1") - F.col("_pre1") * (1.0 + F.col("spec_m2"))
    return out.withColumn("did_pt", 100.0 * ratio(loss, F.col("_base"))).select(
        *keys, "stores", "dose_r", *[f"{name}_{what}" for name in _measures() for what in ("t", "df")], "did_pt"
    )


def store_tests(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Dose-response, specificity and difference-in-differences of every case,
    from its stores, in one aggregate.

    ``panel`` has a row per case and store: ``driver`` (change of the cause),
    ``growth`` (change of the KPI), ``growth_before`` (the period before),
    ``exposed`` (the cause is present), ``now`` and ``before`` (the KPI).  Stores
    that the cause missed are the controls.  ``dose_r`` is the correlation over
    stores; ``spec`` compares growth between exposed and controls, ``did`` the
    change of growth, ``pre`` the growth before (the pre-test); each with Welch's
    t and df.  ``did_pt`` is the exposed stores' loss against the controls'
    growth, over the scope's base.
    """
    return _side_tests(_side_moments(panel, keys, {"1": F.col("exposed"), "2": ~F.col("exposed")}), keys)


def directed_tests(panel: DataFrame, directions: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`store_tests` where the cause is present in the stores it moved the way it moved in the whole scope.

    ``directions`` has a row per case with ``toward`` (1, -1, or 0 for no move,
    which leaves nothing to test).  The panel, with its few and crowded cases, is
    reduced to moments of the stores where the cause rose, fell or stood still;
    these three rows a case meet the direction and are pooled into two sides.
    """
    way = F.signum("driver").cast("int")
    known = F.when(F.col("growth").isNotNull(), F.col("driver"))
    parts = []
    for name, value in _measures().items():
        parts += [F.avg(value).alias(f"{name}_m"), F.var_samp(value).alias(f"{name}_v"), F.count(value).alias(f"{name}_n")]
    ready = F.col("growth").isNotNull()
    by_way = panel.groupBy(*keys, way.alias("way")).agg(
        *parts, F.sum(F.when(ready, F.col("before"))).alias("pre"), F.sum(F.when(ready, F.col("now"))).alias("post"), F.sum("before").alias("base"),
        F.avg(known).alias("x"), F.var_pop(known).alias("xx"), F.covar_pop(known, F.col("growth")).alias("xy"))
    sided = by_way.join(directions.where(F.col("toward") != 0).select(*keys, "toward"), keys).withColumn(
        "hit", F.col("way") == F.col("toward"))
    pooled = []
    for name in _measures():
        m, v, n = (F.col(f"{name}_{part}") for part in "mvn")
        for side, flag in (("1", F.col("hit")), ("2", ~F.col("hit"))):
            mine = lambda c, flag=flag: F.sum(F.when(flag, c))
            count, total = mine(n), mine(n * m)
            mean = ratio(total, count.cast("double"))
            # Squares within the rows, and of their means around the mean of all.
            squares = F.coalesce(mine((n - 1) * v), F.lit(0.0)) + mine(n * m * m) - count * mean * mean
            pooled += [mean.alias(f"{name}_m{side}"), F.coalesce(count, F.lit(0)).alias(f"{name}_n{side}"),
                       F.when(count > 1, F.greatest(squares, F.lit(0.0)) / (count - 1)).alias(f"{name}_v{side}")]
    n, x, y = F.col("spec_n"), F.col("x"), F.col("spec_m")
    size = F.sum(n)
    about = lambda within, a, b: F.sum(n * within) + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.nullif(size, F.lit(0))
    spread_y = F.sum(F.coalesce((n - 1) * F.col("spec_v"), F.lit(0.0))) + F.sum(n * y * y) - F.sum(n * y) * F.sum(n * y) / F.nullif(size, F.lit(0))
    spread_x = about(F.col("xx"), x, x)
    cases = sided.groupBy(*keys).agg(
        size.alias("stores"), ratio(about(F.col("xy"), x, y), F.sqrt(F.when((spread_x > 1e-12) & (spread_y > 0), spread_x * spread_y))).alias("dose_r"),
        F.sum("base").alias("_base"), F.sum(F.when(F.col("hit"), F.col("pre"))).alias("_pre1"), F.sum(F.when(F.col("hit"), F.col("post"))).alias("_post1"), *pooled)
    return _side_tests(cases, keys)


def confounder_screen(hypotheses: DataFrame, keys: list[str]) -> DataFrame:
    """For each live hypothesis, the listed confounders also live and untested.

    ``hypotheses``: keys, hypothesis, confounders, live, tested.  A case has at
    most one row per template, so its window is a handful of rows and the
    screen needs no join.
    """
    rival = F.when(F.col("live") & ~F.col("tested"), F.col("hypothesis"))
    rivals = F.collect_set(rival).over(Window.partitionBy(*keys))
    none = F.array().cast("array<string>")
    return hypotheses.withColumn(
        "unresolved",
        F.when(F.col("live"), F.array_sort(F.array_intersect("confounders", rivals))).otherwise(none),
    ).withColumn("screen_failed", F.size("unresolved") > 0)


def missing_sources(hypotheses: DataFrame) -> DataFrame:
    """Required minus available sources, and the unverifiable flag."""
    return hypotheses.withColumn(
        "missing", F.array_except("required_sources", "available_sources")
    ).withColumn("verifiable", F.size("missing") == 0)


def test_coverage(hypotheses: DataFrame, outcomes: dict[str, Column]) -> DataFrame:
    """Passed over applicable tests, row by row.

    ``outcomes`` gives each test's boolean; only the tests the hypothesis lists
    as applicable count.
    """
    passed = F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in outcomes.items()]))
    return (
        hypotheses.withColumn("applicable", F.size("applicable_tests").cast("long"))
        .withColumn("passed_tests", F.size(F.array_intersect("applicable_tests", passed)).cast("long"))
        .withColumn("coverage", rounded(F.col("passed_tests") / F.col("applicable")))
    )


test_coverage.__test__ = False


def attribute(cells: DataFrame, shrinkage: float = 1.0) -> DataFrame:
    """Attributed part of the residual and the remainder, in points and value.

    Shrinkage is explicit; the default attributes the whole estimate.  An
    estimate of the opposite sign attributes nothing, and none exceeds the
    residual.
    """
    estimate = F.col("did_pt") * F.lit(shrinkage)
    same = F.signum(estimate) == F.signum("residual_pt")
    size = F.when(same, F.least(F.abs(estimate), F.abs("residual_pt"))).otherwise(0.0)
    return (
        cells.withColumn("attributed_pt", F.signum("residual_pt") * size)
        .withColumn("attributed_share", F.coalesce(ratio(F.abs("attributed_pt"), F.abs("residual_pt")), F.lit(0.0)))
        .withColumn("unattributed_pt", F.col("residual_pt") - F.col("attributed_pt"))
        .withColumn("attributed_value", F.col("attributed_pt") / 100.0 * F.col("previous"))
        .withColumn("unattributed_value", F.col("unattributed_pt") / 100.0 * F.col("previous"))
    )
