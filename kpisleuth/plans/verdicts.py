"""Queries over causal tests, confidence, verdicts and actions (M, F and R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import crore, previous_by_period, ratio, rounded
from kpisleuth.functions.stats import p_student_t, welch_t
from kpisleuth.operators import actions, baseline, causal, confidence, evidence, gates, matching, movement
from kpisleuth.plans.cases import decomposed_cells, gated_cells, r, region_price_mix
from kpisleuth.plans.facts import FESTIVAL_SPANS, conformed, region_cells
from kpisleuth.plans.registry import VIEWS, query
from kpisleuth.plans.views import text_list
from kpisleuth.session import written
from kpisleuth.sources import standins, tables

REGION = ["region"]
ONSET = standins.CASE_ONSET
WINDOW_DAYS = 364
CASE = ["region", "period"]
HYP = [*CASE, "hypothesis"]


def located(df: DataFrame, spark, folder, *columns: str) -> DataFrame:
    stores = standins.stores(spark, folder).select("store_id", "region", *columns)
    return df.join(stores, "store_id")


def store_days(spark, folder) -> DataFrame:
    """Store x day net revenue with the treatment flags."""
    daily = conformed(spark, folder).groupBy("store_id", F.col("txn_date").alias("date")).agg(
        F.sum("net_amount").alias("revenue")
    )
    return located(daily, spark, folder, "is_treated", "is_control")


def unit_panel(spark, folder) -> DataFrame:
    """Pre and post revenue per store around the onset, with flags."""
    near = conformed(spark, folder)
    units = causal.unit_growth(near, ["store_id"], "txn_date", "net_amount", ONSET, WINDOW_DAYS)
    return located(units, spark, folder, "is_treated", "is_control")


def availability_days(spark, folder) -> DataFrame:
    return standins.inventory(spark, folder).groupBy("store_id", F.col("snapshot_date").alias("date")).agg(
        F.avg(F.when(F.col("on_hand_units") > 0, 1.0).otherwise(0.0)).alias("availability")
    )


# --- M: causal tests ---------------------------------------------------------
def weekly_series(spark, folder) -> DataFrame:
    """Weekly revenue per region, in crore."""
    weekly = conformed(spark, folder).groupBy(
        "store_id", F.date_trunc("week", "txn_date").cast("date").alias("week")
    ).agg(F.sum("net_amount").alias("net"))
    return located(weekly, spark, folder).groupBy("region", "week").agg(crore(F.sum("net")).alias("value"))


def weekly_availability(spark, folder) -> DataFrame:
    snapshots = standins.inventory(spark, folder).groupBy(
        "store_id", F.date_trunc("week", "snapshot_date").cast("date").alias("week")
    ).agg(F.count_if(F.col("on_hand_units") > 0).alias("ok"), F.count(F.lit(1)).alias("n"))
    return located(snapshots, spark, folder).groupBy("region", "week").agg(
        rounded(100.0 * F.sum("ok") / F.sum("n")).alias("value")
    )


def _onset_sql(series: str) -> str:
    return f"""
(SELECT region, onset, gain, shift FROM (
  SELECT region, week AS onset, gain, shift, row_number() OVER (PARTITION BY region ORDER BY gain DESC NULLS LAST, week) AS rn
  FROM (
    SELECT region, week, n1 * (n - n1) / CAST(n AS DOUBLE) * (s1 / n1 - (s - s1) / (n - n1)) ** 2 AS gain,
      (s - s1) / (n - n1) - s1 / n1 AS shift
    FROM (
      SELECT region, week, count(value) OVER w AS n1, sum(value) OVER w AS s1,
        count(value) OVER (PARTITION BY region) AS n, sum(value) OVER (PARTITION BY region) AS s
      FROM {series} WINDOW w AS (PARTITION BY region ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ) WHERE n1 > 0
  )
) WHERE rn = 1)
"""


_WEEKLY_SQL = """
(SELECT region, CAST(date_trunc('week', txn_date) AS DATE) AS week, round(sum(net) / 1e7, 6) AS value
 FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1, 2)
"""
_WEEKLY_AVAIL_SQL = """
(SELECT region, CAST(date_trunc('week', snapshot_date) AS DATE) AS week,
  round(100.0 * count(*) FILTER (WHERE on_hand_units > 0) / count(*), 6) AS value
 FROM inv_v JOIN stores_v USING (store_id) GROUP BY 1, 2)
"""


@query("m1_onset", f"SELECT region, onset, round(gain, 6) AS gain, round(shift, 6) AS shift FROM {_onset_sql(_WEEKLY_SQL)}")
def m1(spark, folder):
    return causal.onset(weekly_series(spark, folder), REGION, "week").select("region", "onset", r("gain"), r("shift"))


def _partition_sql(tag: str, series: str, key: str, day: str, scale: float = 3.0) -> dict[str, str]:
    """All changepoints of the series (key, day, value), by the whole recursion over ends and starts."""
    return {
        f"{tag}_series_v": f"""
SELECT {key}, list({day} ORDER BY {day}) AS days, list(value ORDER BY {day}) AS v, count(*) AS n FROM {series} WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 4
""",
        f"{tag}_sums_v": f"""
SELECT {key}, days, v, n, list_transform(range(n + 1), lambda e: CASE WHEN e = 0 THEN 0.0 ELSE list_sum(v[1:e]) END) AS c1,
  list_transform(range(n + 1), lambda e: CASE WHEN e = 0 THEN 0.0 ELSE list_sum(list_transform(v[1:e], lambda x: x * x)) END) AS c2,
  {scale} * pow(greatest(list_median(list_transform(range(1, n), lambda i: abs(v[i + 1] - v[i]))) / 0.9539, {causal.LEAST_NOISE}), 2) * ln(n) AS penalty
FROM {tag}_series_v
""",
        f"{tag}_best_v": f"""
SELECT {key}, CAST(1 AS BIGINT) AS e, [-penalty, 'inf'::DOUBLE] AS best, [CAST(0 AS BIGINT), 0] AS previous FROM {tag}_sums_v
UNION ALL
SELECT {key}, e + 1, list_append(best, list_min(totals) + penalty), list_append(previous, CAST(list_position(totals, list_min(totals)) - 1 AS BIGINT))
FROM (SELECT b.{key}, b.e, b.best, b.previous, s.penalty, list_transform(range(b.e), lambda t: b.best[t + 1]
    + (s.c2[b.e + 2] - s.c2[t + 1] - pow(s.c1[b.e + 2] - s.c1[t + 1], 2) / (b.e + 1 - t))) AS totals
  FROM {tag}_best_v b JOIN {tag}_sums_v s ON s.{key} = b.{key} WHERE b.e < s.n)
""",
        f"{tag}_cut_v": f"""
SELECT b.{key}, s.n AS until, b.previous[s.n + 1] AS cut, b.previous FROM {tag}_best_v b JOIN {tag}_sums_v s ON s.{key} = b.{key} AND s.n = b.e
UNION ALL SELECT {key}, cut, previous[cut + 1], previous FROM {tag}_cut_v WHERE cut > 0
""",
        f"{tag}_onset_v": f"""
SELECT c.{key}, s.days[c.cut + 1] AS onset, CAST(c.cut AS INTEGER) AS position,
  list_avg(s.v[c.cut + 1:c.until]) - list_avg(s.v[p.cut + 1:c.cut]) AS shift
FROM {tag}_cut_v c JOIN {tag}_cut_v p ON p.{key} = c.{key} AND p.until = c.cut JOIN {tag}_sums_v s ON s.{key} = c.{key} WHERE c.cut > 0
""",
    }


FINE_SCALE = 0.5  # a sixth of the usual price of a change
VIEWS["store_month_cr_v"] = """
SELECT store_id, CAST(date_trunc('month', txn_date) AS DATE) AS month, round(sum(net) / 1e7, 6) AS value FROM scope_v GROUP BY 1, 2
"""
VIEWS |= _partition_sql("pelt_store", "store_month_cr_v", "store_id", "month")
VIEWS |= _partition_sql("pelt_fine", "store_month_cr_v", "store_id", "month", FINE_SCALE)
VIEWS |= _partition_sql("pelt_cause", _WEEKLY_AVAIL_SQL, "region", "week")
VIEWS |= _partition_sql("pelt_effect", _WEEKLY_SQL, "region", "week")


def store_months(spark, folder) -> DataFrame:
    """Monthly revenue per store, in crore."""
    return conformed(spark, folder).groupBy(
        "store_id", F.date_trunc("month", "txn_date").cast("date").alias("month")
    ).agg(crore(F.sum("net_amount")).alias("value"))


@query("m1_onsets_all", "SELECT store_id, onset, position, round(shift, 6) AS shift FROM pelt_store_onset_v")
def m1_all(spark, folder):
    """All changepoints of each store's monthly revenue."""
    return causal.onsets(store_months(spark, folder), ["store_id"], "store_id long", "month").select(
        "store_id", "onset", "position", r("shift")
    )


@query("m1_onsets_fine", "SELECT store_id, onset, position, round(shift, 13) AS shift FROM pelt_fine_onset_v")
def m1_fine(spark, folder):
    """The same with small changes as well."""
    return causal.onsets(store_months(spark, folder), ["store_id"], "store_id long", "month", FINE_SCALE).select(
        "store_id", "onset", "position", r("shift", 13)
    )


@query("m2_precedence", f"""
SELECT region, effect_onset, cause_onset, CAST(effect_onset - cause_onset AS INTEGER) AS lag_days,
  coalesce(effect_onset - cause_onset BETWEEN 1 AND {config.PRECEDENCE_MAX_LAG_DAYS}, false) AS passed
FROM (SELECT s.region, e.onset AS effect_onset, coalesce(max(c.onset) FILTER (WHERE c.onset <= e.onset), min(c.onset) FILTER (WHERE e.onset IS NOT NULL)) AS cause_onset
  FROM (SELECT DISTINCT region FROM stores_v) s LEFT JOIN pelt_effect_onset_v e USING (region) LEFT JOIN pelt_cause_onset_v c USING (region) GROUP BY 1, 2)
""")
def m2(spark, folder):
    """A region whose revenue never changed has one row without an onset."""
    cause = causal.onsets(weekly_availability(spark, folder), REGION, "region string", "week")
    effect = causal.onsets(weekly_series(spark, folder), REGION, "region string", "week")
    found = causal.precedence(cause, effect, REGION)
    return standins.stores(spark, folder).select("region").distinct().join(found, REGION, "left").withColumn(
        "passed", F.coalesce("passed", F.lit(False)))


_SLICE = len(config.HYPOTHESES)
VIEWS["slice_v"] = f"""
SELECT region, store_id, CAST(date_trunc('month', txn_date) AS DATE) AS period, CAST(sku_id % {_SLICE} AS INTEGER) AS hypothesis_no,
  sum(net) AS net, count(*) AS n
FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1, 2, 3, 4
"""
VIEWS["hyp_parts_v"] = """
SELECT region, period, hypothesis_no, round(sum(net) / 1e7, 6) AS net, CAST(sum(n) AS BIGINT) AS n FROM slice_v GROUP BY 1, 2, 3
"""
VIEWS["cause_v"] = f"""
SELECT region, store_id, CAST(date_trunc('month', snapshot_date) AS DATE) AS period, CAST(sku_id % {_SLICE} AS INTEGER) AS hypothesis_no,
  count(*) FILTER (WHERE on_hand_units > 0) AS ok, count(*) AS n
FROM inv_v JOIN stores_v USING (store_id) GROUP BY 1, 2, 3, 4
"""
VIEWS["cause_region_v"] = """
SELECT region, period, hypothesis_no, sum(ok) / CAST(sum(n) AS DOUBLE) AS level FROM cause_v GROUP BY 1, 2, 3
"""
VIEWS["cause_move_v"] = """
SELECT c.region, c.period, c.hypothesis_no, c.level - p.level AS change
FROM cause_region_v c JOIN cause_region_v p ON p.region = c.region AND p.hypothesis_no = c.hypothesis_no
  AND p.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
"""
VIEWS["store_total_v"] = "SELECT store_id, period, sum(net) AS total FROM slice_v GROUP BY 1, 2"
VIEWS["store_panel_v"] = """
SELECT *, now / nullif(before, 0) - 1.0 AS growth, before / nullif(earlier, 0) - 1.0 AS growth_before FROM (
  SELECT c.region, c.period, c.hypothesis_no, c.store_id, c.ok / CAST(c.n AS DOUBLE) - p.ok / CAST(p.n AS DOUBLE) AS driver,
    sign(c.ok / CAST(c.n AS DOUBLE) - p.ok / CAST(p.n AS DOUBLE)) = sign(m.change) AS exposed,
    round(t0.total - coalesce(s0.net, 0), 4) AS now, round(t1.total - coalesce(s1.net, 0), 4) AS before,
    round(t2.total - coalesce(s2.net, 0), 4) AS earlier
  FROM cause_v c
  JOIN cause_v p ON p.store_id = c.store_id AND p.hypothesis_no = c.hypothesis_no AND p.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
  JOIN cause_move_v m ON m.region = c.region AND m.hypothesis_no = c.hypothesis_no AND m.period = c.period AND m.change <> 0
  JOIN store_total_v t0 ON t0.store_id = c.store_id AND t0.period = c.period
  LEFT JOIN store_total_v t1 ON t1.store_id = c.store_id AND t1.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
  LEFT JOIN store_total_v t2 ON t2.store_id = c.store_id AND t2.period = CAST(c.period - INTERVAL 2 MONTH AS DATE)
  LEFT JOIN slice_v s0 ON s0.store_id = c.store_id AND s0.hypothesis_no = c.hypothesis_no AND s0.period = c.period
  LEFT JOIN slice_v s1 ON s1.store_id = c.store_id AND s1.hypothesis_no = c.hypothesis_no AND s1.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
  LEFT JOIN slice_v s2 ON s2.store_id = c.store_id AND s2.hypothesis_no = c.hypothesis_no AND s2.period = CAST(c.period - INTERVAL 2 MONTH AS DATE))
"""


def _moment_sql(name: str, value: str) -> str:
    sides = (("1", "exposed"), ("2", "NOT exposed"))
    return ", ".join(f"avg({value}) FILTER (WHERE {flag}) AS {name}_m{k}, var_samp({value}) FILTER (WHERE {flag}) AS {name}_v{k}, "
                     f"count({value}) FILTER (WHERE {flag}) AS {name}_n{k}" for k, flag in sides)


def _welch_sql(n: str) -> str:
    a, b = f"{n}_v1 / {n}_n1", f"{n}_v2 / {n}_n2"
    return (f"({n}_m1 - {n}_m2) / nullif(sqrt({a} + {b}), 0) AS {n}_t, "
            f"({a} + {b}) ** 2 / nullif(({a}) ** 2 / ({n}_n1 - 1) + ({b}) ** 2 / ({n}_n2 - 1), 0) AS {n}_df")


def _p_sql(t: str, df: str) -> str:
    """Two-sided Student p by the midpoint rule over the angle atan(t / sqrt(df))."""
    area = lambda top: f"(SELECT sum(pow(cos({top} * (k + 0.5) / 400), {df} - 1)) * {top} / 400 FROM range(400) AS r(k))"
    return f"1.0 - {area(f'atan(abs({t}) / sqrt({df}))')} / {area('(pi() / 2)')}"


VIEWS["store_tests_v"] = f"""
SELECT region, period, hypothesis_no, stores, nullif(dose_r, 'NaN'::DOUBLE) AS dose_r, {_welch_sql("spec")}, {_welch_sql("did")}, {_welch_sql("pre")},
  100.0 * (post - pre * (1.0 + g)) / nullif(base, 0) AS did_pt
FROM (SELECT region, period, hypothesis_no, count(growth) AS stores, corr(driver, growth) AS dose_r,
    {_moment_sql("spec", "growth")}, {_moment_sql("did", "(growth - growth_before)")}, {_moment_sql("pre", "growth_before")},
    avg(growth) FILTER (WHERE NOT exposed) AS g, sum(before) FILTER (WHERE exposed AND growth IS NOT NULL) AS pre,
    sum(now) FILTER (WHERE exposed AND growth IS NOT NULL) AS post, sum(before) AS base
  FROM store_panel_v GROUP BY 1, 2, 3)
"""


def _first_shift_sql(series: str, keys: str) -> str:
    """Onset of each series (keys, period, value): the split of the largest gain, the earliest of equals."""
    return f"""
(SELECT {keys}, period AS onset FROM (
  SELECT {keys}, period, row_number() OVER (PARTITION BY {keys} ORDER BY n1 * (n - n1) / CAST(n AS DOUBLE) * (s1 / n1 - (s - s1) / (n - n1)) ** 2 DESC NULLS LAST, period) AS rn
  FROM (SELECT {keys}, period, count(value) OVER w AS n1, sum(value) OVER w AS s1, count(value) OVER (PARTITION BY {keys}) AS n,
      sum(value) OVER (PARTITION BY {keys}) AS s
    FROM {series} WINDOW w AS (PARTITION BY {keys} ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n1 > 0
) WHERE rn = 1)
"""


VIEWS["onsets_v"] = f"""
SELECT c.region, c.hypothesis_no, c.onset < e.onset AS passed
FROM {_first_shift_sql("(SELECT region, hypothesis_no, period, round(100.0 * level, 6) AS value FROM cause_region_v)", "region, hypothesis_no")} c
JOIN {_first_shift_sql("(SELECT region, period, value FROM cells_v)", "region")} e USING (region)
"""
VIEWS["hyp_board_v"] = f"""
SELECT *, 100.0 * volume_share * {config.AVAILABILITY_BETA} * abs(driver_change) AS max_impact_pt,
  100.0 * volume_share * {config.AVAILABILITY_BETA} * abs(driver_change) / nullif(abs(residual_pt), 0) AS impact_share,
  coalesce(sign(driver_change) = sign(residual_pt), false) AS live, did_t IS NOT NULL AS tested,
  CASE WHEN sign(did_pt) = sign(residual_pt) THEN least(abs(did_pt), abs(residual_pt)) / nullif(abs(residual_pt), 0) ELSE 0.0 END AS attributed_share,
  coalesce({_p_sql("pre_t", "pre_df")} > {config.PRETREND_MIN_P}, false) AS pretest_passed,
  coalesce(dose_r >= {config.DOSE_MIN_R}, false) AS dose_passed,
  coalesce({_p_sql("spec_t", "spec_df")} <= {config.SPECIFICITY_MAX_P} AND sign(spec_t) = sign(driver_change), false) AS specificity_passed,
  coalesce({_p_sql("did_t", "did_df")} <= {config.DID_MAX_P} AND sign(did_t) = sign(driver_change), false) AS did_significant
FROM (
  SELECT c.region, c.period, h.hypothesis, d.residual_pt, d.headline_pt, d.previous AS cell_previous, d.value AS cell_value,
    c.net / nullif(d.value, 0) AS volume_share, m.change AS driver_change,
    coalesce(o.passed, false) AS precedence_passed, t.dose_r, t.spec_t, t.spec_df, t.did_t, t.did_df, t.pre_t, t.pre_df, t.did_pt
  FROM hyp_parts_v c JOIN hyp_v h USING (hypothesis_no)
  JOIN decomposed_v d ON d.region = c.region AND d.period = c.period AND d.residual_pt IS NOT NULL
  JOIN hyp_parts_v p ON p.region = c.region AND p.hypothesis_no = c.hypothesis_no AND p.period = CAST(c.period - INTERVAL 1 MONTH AS DATE)
  LEFT JOIN cause_move_v m ON m.region = c.region AND m.period = c.period AND m.hypothesis_no = c.hypothesis_no
  LEFT JOIN onsets_v o ON o.region = c.region AND o.hypothesis_no = c.hypothesis_no
  LEFT JOIN store_tests_v t ON t.region = c.region AND t.period = c.period AND t.hypothesis_no = c.hypothesis_no
  WHERE c.n > 1 AND p.n > 1
)
"""


def slice_sums(spark, folder) -> DataFrame:
    """Net revenue per (store, month, hypothesis slice), whether or not the store is in the dimension.

    Each hypothesis owns a slice of the SKUs.  Written once: the board, the
    store tests and the gates of the verdict start from it.
    """
    per_store = conformed(spark, folder).groupBy(
        "store_id", F.date_trunc("month", "txn_date").cast("date").alias("period"),
        (F.col("sku_id") % _SLICE).cast("int").alias("hypothesis_no"),
    ).agg(F.sum("net_amount").alias("net"), F.count(F.lit(1)).alias("n"), F.bit_or(gates.week_mask("txn_date")).alias("weeks"),
          *baseline.moment_sums(F.col("net_amount"), F.col("txn_date"), FESTIVAL_SPANS))
    return written(per_store, "store-slices")


def store_slices(spark, folder, sums: DataFrame | None = None) -> DataFrame:
    """The same with the region of the store."""
    return located(slice_sums(spark, folder) if sums is None else sums, spark, folder)


def store_causes(spark, folder) -> DataFrame:
    """What may have moved each slice, per (store, month, hypothesis): shelf checks with stock, and all of them.

    Taken from the shelf snapshots, not from sales, so that a cause is not made of
    the outcome that it is tested on.
    """
    per_store = standins.inventory(spark, folder).groupBy(
        "store_id", F.date_trunc("month", "snapshot_date").cast("date").alias("period"),
        (F.col("sku_id") % _SLICE).cast("int").alias("hypothesis_no"),
    ).agg(F.count_if(F.col("on_hand_units") > 0).alias("ok"), F.count(F.lit(1)).alias("n"))
    return written(located(per_store, spark, folder), "store-causes")


def slice_months(slices: DataFrame) -> DataFrame:
    """The same by region; at most regions x months x templates rows."""
    return written(slices.groupBy(*CASE, "hypothesis_no").agg(
        F.sum("net").alias("net"), F.sum("n").alias("n"), F.bit_or("weeks").alias("weeks"), *baseline.moment_totals(FESTIVAL_SPANS)), "slice-months")


def cause_months(causes: DataFrame) -> DataFrame:
    """Level of each cause by region and month, its change, and the way it moved."""
    level = F.sum("ok") / F.sum("n")
    monthly = causes.groupBy(*CASE, "hypothesis_no").agg(level.alias("level"))
    before = previous_by_period(F.col("level"), ["region", "hypothesis_no"], "period")
    return written(monthly.withColumn("change", F.col("level") - before).withColumn("toward", F.signum("change")), "cause-months")


def store_outcomes(slices: DataFrame, causes: DataFrame) -> DataFrame:
    """Per (store, month, hypothesis) with a cause on record this month and the last: ``driver``, its change in the
    store, and the store's revenue without the hypothesis' own slice (``now``, ``before``, ``earlier``) with its growth.

    Leaving the slice out keeps a hypothesis from explaining itself.
    """
    totals = slices.groupBy("store_id", "period").agg(F.sum("net").alias("t0"))
    staged = totals.withColumn("t1", previous_by_period(F.col("t0"), ["store_id"], "period"))
    whole = staged.withColumn("t2", previous_by_period(F.col("t1"), ["store_id"], "period"))
    number = [F.lit(None).cast("long").alias(c) for c in ("ok", "n")]
    keys = ["region", "store_id", "period", "hypothesis_no"]
    both = slices.select(*keys, "net", *number).unionByName(causes.select(*keys, F.lit(None).cast("double").alias("net"), "ok", "n"))
    # Dealt as the windows need it, so the aggregate shuffles nothing of its own.
    slots = both.repartition(F.col("store_id"), F.col("hypothesis_no")).groupBy(*keys).agg(
        F.sum("net").alias("own"), (F.sum("ok") / F.sum("n")).alias("level")).withColumn("_m", F.year("period") * 12 + F.month("period"))
    months = Window.partitionBy("store_id", "hypothesis_no").orderBy("_m")
    ago = lambda c, k: F.sum(c).over(months.rangeBetween(-k, -k))  # noqa: E731 (one row, or none)
    panel = slots.withColumns({"own1": ago("own", 1), "own2": ago("own", 2), "driver": F.col("level") - ago("level", 1)}).where(
        "driver IS NOT NULL").join(whole, ["store_id", "period"])
    without = lambda total, own: F.round(F.col(total) - F.coalesce(own, F.lit(0.0)), 4)
    panel = panel.select(*keys, "driver", without("t0", "own").alias("now"), without("t1", "own1").alias("before"),
                         without("t2", "own2").alias("earlier"))
    return panel.withColumns({"growth": ratio(F.col("now"), F.col("before")) - 1.0,
                              "growth_before": ratio(F.col("before"), F.col("earlier")) - 1.0})


def tested_slices(slices: DataFrame, causes: DataFrame, moves: DataFrame) -> DataFrame:
    """Store tests of every (region, month, slice); ``moves`` tell which way each cause went in the region."""
    found = causal.directed_tests(store_outcomes(slices, causes), moves, [*CASE, "hypothesis_no"])
    for name in ("spec", "did", "pre"):
        found = found.withColumn(f"{name}_p", p_student_t(f"{name}_t", f"{name}_df"))
    return found


def hypothesis_board(spark, folder, slices: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """One row per (region, month, hypothesis): share, change of the cause, tests."""
    if slices is None:
        slices = store_slices(spark, folder)
    if parts is None:
        parts = slice_months(slices)
    stock = store_causes(spark, folder)
    moves = cause_months(stock)
    keys = ["region", "hypothesis_no"]
    sized = parts.withColumn("net", crore(F.col("net")))
    staged = sized.withColumn("_b", previous_by_period(F.struct("net", "n"), keys, "period"))
    named = staged.join(F.broadcast(config.hypothesis_table(spark).select("hypothesis_no", "hypothesis")), "hypothesis_no")
    sums = parts.groupBy(*CASE).agg(F.sum("net").alias("net"), *baseline.moment_totals(FESTIVAL_SPANS))
    totals = written(baseline.with_moments(sums, CASE, "net", FESTIVAL_SPANS), "slice-totals")
    cells = movement.decompose(baseline.calendar_expected(totals, REGION, "region string", FESTIVAL_SPANS), REGION).where(
        "residual_pt IS NOT NULL"
    ).select(*CASE, "residual_pt", "headline_pt", F.col("previous").alias("cell_previous"), F.col("value").alias("cell_value"))
    causes = causal.onset(moves.select(*keys, "period", rounded(100.0 * F.col("level")).alias("value")), keys, "period")
    effects = causal.onset(totals, REGION, "period")
    first = causes.select(*keys, F.col("onset").alias("_cause")).join(
        effects.select("region", F.col("onset").alias("_effect")), "region"
    ).select(*keys, (F.col("_cause") < F.col("_effect")).alias("_precedes"))
    board = (
        named.where("n > 1 AND _b.n > 1").join(cells, CASE).join(first, keys, "left")
        .join(moves.select(*CASE, "hypothesis_no", "change"), [*CASE, "hypothesis_no"], "left")
        .join(tested_slices(slices, stock, moves), [*CASE, "hypothesis_no"], "left")
        .select(
            *HYP, "residual_pt", "headline_pt", "cell_previous", "cell_value",
            ratio(F.col("net"), F.col("cell_value")).alias("volume_share"),
            F.col("change").alias("driver_change"),
            F.coalesce("_precedes", F.lit(False)).alias("precedence_passed"),
            F.lit(config.AVAILABILITY_BETA).alias("elasticity"),
            "dose_r", "spec_t", "spec_p", "did_t", "did_p", "pre_p", "did_pt",
        )
    )
    agrees = lambda c, other: F.coalesce(F.signum(c) == F.signum(other), F.lit(False))
    sure = lambda c: F.coalesce(c, F.lit(False))
    part = F.least(F.abs("did_pt"), F.abs("residual_pt"))
    return written(
        causal.sufficiency(board)
        .withColumn("live", agrees("driver_change", "residual_pt"))
        .withColumn("tested", F.col("did_t").isNotNull())
        .withColumn("attributed_share", F.when(agrees("did_pt", "residual_pt"), ratio(part, F.abs("residual_pt"))).otherwise(0.0))
        .withColumn("pretest_passed", sure(F.col("pre_p") > config.PRETREND_MIN_P))
        .withColumn("dose_passed", sure(F.col("dose_r") >= config.DOSE_MIN_R))
        .withColumn("specificity_passed", sure(F.col("spec_p") <= config.SPECIFICITY_MAX_P) & agrees("spec_t", "driver_change"))
        .withColumn("did_significant", sure(F.col("did_p") <= config.DID_MAX_P) & agrees("did_t", "driver_change")),
        "hypotheses",
    )


@query("m3_sufficiency", f"""
SELECT region, period, hypothesis, round(max_impact_pt, 6) AS max_impact_pt, round(impact_share, 6) AS impact_share,
  impact_share >= {config.SUFFICIENCY_SHARE} AS passed FROM hyp_board_v
""")
def m3(spark, folder):
    return hypothesis_board(spark, folder).select(*HYP, r("max_impact_pt"), r("impact_share"), "passed")


_AVAIL_UNIT_SQL = """
(SELECT store_id, avg(CASE WHEN date < DATE '1998-06-01' THEN availability END)
   - avg(CASE WHEN date >= DATE '1998-06-01' THEN availability END) AS gap
 FROM avail_v WHERE date >= DATE '1998-06-01' - 364 AND date < DATE '1998-06-01' + 364 GROUP BY 1)
"""


@query("m4_dose_response", f"""
SELECT region, count(CASE WHEN gap IS NOT NULL AND decline IS NOT NULL THEN 1 END) AS n, round(nullif(corr(gap, decline), 'NaN'::DOUBLE), 6) AS r,
  round(nullif(regr_slope(decline, gap), 'NaN'::DOUBLE), 6) AS slope,
  round(nullif(regr_intercept(decline, gap), 'NaN'::DOUBLE), 6) AS intercept,
  round(nullif(regr_r2(decline, gap), 'NaN'::DOUBLE), 6) AS r2, nullif(corr(gap, decline), 'NaN'::DOUBLE) >= 0.3 AS passed
FROM (SELECT region, gap, -100.0 * growth AS decline FROM units_v JOIN {_AVAIL_UNIT_SQL} USING (store_id)) GROUP BY 1
""")
def m4(spark, folder):
    at = F.lit(ONSET).cast("date")
    near = availability_days(spark, folder).where(
        (F.col("date") >= F.date_sub(at, WINDOW_DAYS)) & (F.col("date") < F.date_add(at, WINDOW_DAYS))
    )
    gaps = evidence.before_after(near, ["store_id"], "date", F.col("availability"), ONSET)
    panel = unit_panel(spark, folder).join(gaps.select("store_id", "gap"), "store_id").withColumn(
        "decline", -100.0 * F.col("growth")
    )
    return causal.dose_response(panel, REGION, "gap", "decline").select(
        "region", "n", r("r"), r("slope"), r("intercept"), r("r2"), "passed"
    )


_WELCH_SQL = """
(SELECT region, avg(growth) FILTER (WHERE is_treated) AS m1, var_samp(growth) FILTER (WHERE is_treated) AS v1,
  count(growth) FILTER (WHERE is_treated) AS n1, avg(growth) FILTER (WHERE NOT is_treated) AS m2,
  var_samp(growth) FILTER (WHERE NOT is_treated) AS v2, count(growth) FILTER (WHERE NOT is_treated) AS n2
 FROM units_v GROUP BY 1)
"""


def welch_regions(spark, folder) -> DataFrame:
    return causal.welch(unit_panel(spark, folder), REGION, "is_treated", "growth")


@query("m5_specificity", f"""
SELECT region, n1, n2, round((m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0), 6) AS t,
  round((v1 / n1 + v2 / n2) ** 2 / nullif((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1), 0), 6) AS df FROM {_WELCH_SQL}
""")
def m5(spark, folder):
    return welch_regions(spark, folder).select("region", "n1", "n2", r("t"), r("df"))


@query("m5_specificity_p", f"""
SELECT region, round(t, 6) AS t, round({_p_sql("t", "df")}, 4) AS p_value, {_p_sql("t", "df")} <= {config.SPECIFICITY_MAX_P} AS passed
FROM (SELECT region, (m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0) AS t,
  (v1 / n1 + v2 / n2) ** 2 / nullif((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1), 0) AS df FROM {_WELCH_SQL})
""")
def m5_p(spark, folder):
    return welch_regions(spark, folder).withColumn("p_value", p_student_t("t", "df")).select(
        "region", r("t"), r("p_value", 4), (F.col("p_value") <= config.SPECIFICITY_MAX_P).alias("passed")
    )


COVARIATES = ["size_index", "sqft", "staff_headcount"]
BLOCK = ["region", "catchment_type"]


def matching_units(spark, folder) -> DataFrame:
    """Treated stores (odd-numbered catchments hold both groups) and the rest."""
    return standins.stores(spark, folder).select(
        "store_id", *BLOCK, *COVARIATES, (F.col("store_id") % 5 == 0).alias("is_case")
    )


_Z = ", ".join(
    f"(u.{c} - s.m_{c}) / CASE WHEN coalesce(s.s_{c}, 0) = 0 THEN 1.0 ELSE s.s_{c} END AS z_{c}" for c in COVARIATES
)
_MATCH_UNITS_SQL = f"""
(SELECT u.store_id, u.region, u.catchment_type, u.store_id % 5 = 0 AS is_case, {_Z}
 FROM stores_v u JOIN (SELECT region, catchment_type,
   {", ".join(f"avg({c}) FILTER (WHERE store_id % 5 <> 0) AS m_{c}, stddev_pop({c}) FILTER (WHERE store_id % 5 <> 0) AS s_{c}" for c in COVARIATES)}
   FROM stores_v GROUP BY 1, 2) s ON s.region = u.region AND s.catchment_type = u.catchment_type)
"""


@query("m6_match_with_reuse", f"""
SELECT region, catchment_type, treated_id, candidate_id, round(distance, 6) AS distance FROM (
  SELECT t.region, t.catchment_type, t.store_id AS treated_id, c.store_id AS candidate_id,
    sqrt({" + ".join(f"(t.z_{c} - c.z_{c}) ** 2" for c in COVARIATES)}) AS distance,
    row_number() OVER (PARTITION BY t.store_id ORDER BY sqrt({" + ".join(f"(t.z_{c} - c.z_{c}) ** 2" for c in COVARIATES)}), c.store_id) AS rn
  FROM {_MATCH_UNITS_SQL} t JOIN {_MATCH_UNITS_SQL} c ON t.region = c.region AND t.catchment_type = c.catchment_type
  WHERE t.is_case AND NOT c.is_case
) WHERE rn = 1
""")
def m6(spark, folder):
    matched = matching.match_with_reuse(matching_units(spark, folder), BLOCK, COVARIATES, "store_id", "is_case")
    return matched.select(*BLOCK, "treated_id", "candidate_id", r("distance"))


@query("m6_match_without_reuse")
def m6_greedy(spark, folder):
    matched = matching.match_without_reuse(matching_units(spark, folder), BLOCK, COVARIATES, "store_id", "is_case")
    return matched.select(*BLOCK, "treated_id", "candidate_id", r("distance"))


@query("m7_pre_trend", """
SELECT store_id, count(*) AS weeks, round(CASE WHEN count(*) > 1 THEN regr_slope(value, week) / 1e5 END, 6) AS slope FROM (
  SELECT store_id, CAST(floor((txn_date - DATE '1998-06-01') / 7) AS BIGINT) AS week, sum(net) AS value FROM scope_v
  WHERE txn_date >= DATE '1998-06-01' - 56 AND txn_date < DATE '1998-06-01' GROUP BY 1, 2
) GROUP BY 1
""")
def m7(spark, folder):
    slopes = causal.pre_trend(conformed(spark, folder), "store_id", "txn_date", "net_amount", ONSET)
    return slopes.select("store_id", "weeks", rounded(F.col("slope") / config.LAKH).alias("slope"))


_TREND_SQL = """
(SELECT region, count(*) AS weeks, regr_slope(y, week) AS slope, regr_r2(y, week) AS r2 FROM (
  SELECT region, week, CASE WHEN tr > 0 AND co > 0 THEN ln(tr / co) END AS y FROM (
    SELECT region, CAST(floor((txn_date - DATE '1998-06-01') / 7) AS BIGINT) AS week,
      sum(net) FILTER (WHERE is_treated) AS tr, sum(net) FILTER (WHERE is_control) AS co
    FROM scope_v JOIN stores_v USING (store_id)
    WHERE txn_date >= DATE '1998-06-01' - 56 AND txn_date < DATE '1998-06-01' GROUP BY 1, 2
  )) WHERE y IS NOT NULL GROUP BY 1)
"""


def trend_regions(spark, folder) -> DataFrame:
    return causal.parallel_trends(
        store_days(spark, folder), REGION, "date", "revenue", ONSET
    )


@query("m8_parallel_trends", f"""
SELECT region, weeks, weeks - 2 AS df, round(slope, 6) AS slope,
  round(CASE WHEN weeks > 2 THEN sign(slope) * sqrt(r2 * (weeks - 2) / nullif(1.0 - r2, 0)) END, 6) AS t FROM {_TREND_SQL}
""")
def m8(spark, folder):
    return trend_regions(spark, folder).select("region", "weeks", "df", r("slope"), r("t"))


@query("m8_parallel_trends_p", f"""
SELECT region, weeks, round(t, 6) AS t, round({_p_sql("t", "df")}, 4) AS p_value, {_p_sql("t", "df")} > {config.PRETREND_MIN_P} AS passed
FROM (SELECT region, weeks, CAST(weeks - 2 AS DOUBLE) AS df,
  CASE WHEN weeks > 2 THEN sign(slope) * sqrt(r2 * (weeks - 2) / nullif(1.0 - r2, 0)) END AS t FROM {_TREND_SQL})
""")
def m8_p(spark, folder):
    return trend_regions(spark, folder).withColumn("p_value", p_student_t("t", F.col("df").cast("double"))).select(
        "region", "weeks", r("t"), r("p_value", 4), (F.col("p_value") > config.PRETREND_MIN_P).alias("passed")
    )


DID_BLOCK = ["region", "store_format", "catchment_type"]
DID_COVARIATES = ["sqft", "staff_headcount", "pre_trend"]


def matched_stores(spark, folder, units: DataFrame) -> DataFrame:
    """Treated stores and their matched controls around the onset."""
    slopes = causal.pre_trend(conformed(spark, folder), "store_id", "txn_date", "net_amount", ONSET).select(
        "store_id", rounded(F.col("slope") / config.LAKH).alias("pre_trend"))
    traits = standins.stores(spark, folder).select("store_id", "store_format", "catchment_type", "sqft", "staff_headcount")
    ready = units.where((F.col("is_treated") | F.col("is_control")) & F.col("growth").isNotNull()).join(traits, "store_id").join(
        slopes, "store_id", "left").withColumn("pre_trend", F.coalesce("pre_trend", F.lit(0.0)))
    return written(matching.matched_pairs(
        written(ready, "did-stores"), DID_BLOCK, DID_COVARIATES, "store_id", "is_treated", config.MATCH_CALIPER, ["pre", "post", "growth"]), "did-pairs")


def matched_effect(spark, folder) -> DataFrame:
    """Per region: the matched estimate, its loss over the scope's base, and the balance of the match."""
    units = written(unit_panel(spark, folder), "did-units")
    pairs = matched_stores(spark, folder, units)
    scope = units.groupBy(*REGION).agg(F.count_if("is_treated").alias("treated"), F.sum("pre").alias("base"))
    found = causal.matched_did(pairs, REGION).withColumnRenamed("did_pt", "gap_pt").join(
        matching.worst_imbalance(pairs, REGION, DID_COVARIATES), REGION)
    return scope.join(found, REGION, "left").withColumn("did_pt", 100.0 * ratio(F.col("loss"), F.col("base")))


VIEWS["trend_v"] = """
SELECT store_id, round(CASE WHEN count(*) > 1 THEN regr_slope(value, week) / 1e5 END, 6) AS slope FROM (
  SELECT store_id, CAST(floor((txn_date - DATE '1998-06-01') / 7) AS BIGINT) AS week, sum(net) AS value FROM scope_v
  WHERE txn_date >= DATE '1998-06-01' - 56 AND txn_date < DATE '1998-06-01' GROUP BY 1, 2
) GROUP BY 1
"""
VIEWS["did_unit_v"] = """
SELECT u.*, s.store_format, s.catchment_type, s.sqft, s.staff_headcount, coalesce(t.slope, 0.0) AS pre_trend
FROM units_v u JOIN stores_v s USING (store_id) LEFT JOIN trend_v t USING (store_id)
WHERE (u.is_treated OR u.is_control) AND u.growth IS NOT NULL
"""
_DID_Z = ", ".join(f"(u.{c} - s.m_{c}) / CASE WHEN coalesce(s.s_{c}, 0) = 0 THEN 1.0 ELSE s.s_{c} END AS z_{c}" for c in DID_COVARIATES)
_DID_STATS = ", ".join(f"avg({c}) FILTER (WHERE NOT is_treated) AS m_{c}, stddev_pop({c}) FILTER (WHERE NOT is_treated) AS s_{c}" for c in DID_COVARIATES)
VIEWS["did_z_v"] = f"""
SELECT u.*, {_DID_Z} FROM did_unit_v u
JOIN (SELECT region, store_format, catchment_type, {_DID_STATS} FROM did_unit_v GROUP BY 1, 2, 3) s USING (region, store_format, catchment_type)
"""
_DID_DISTANCE = "sqrt(" + " + ".join(f"(t.z_{c} - c.z_{c}) ** 2" for c in DID_COVARIATES) + ")"
VIEWS["did_pair_v"] = f"""
SELECT * FROM (
  SELECT t.region, t.store_id AS treated_id, c.store_id AS control_id, {_DID_DISTANCE} AS distance, t.growth AS t_growth, c.growth AS c_growth,
    t.pre AS t_pre, t.post AS t_post, {", ".join(f"t.{c} AS t_{c}, c.{c} AS c_{c}" for c in DID_COVARIATES)},
    row_number() OVER (PARTITION BY t.store_id ORDER BY {_DID_DISTANCE}, c.store_id) AS place
  FROM did_z_v t JOIN did_z_v c ON t.region = c.region AND t.store_format = c.store_format AND t.catchment_type = c.catchment_type
  WHERE t.is_treated AND NOT c.is_treated
) WHERE place = 1 AND distance <= {config.MATCH_CALIPER}
"""
_SMD = ", ".join(
    f"CASE WHEN avg(t_{c}) = avg(c_{c}) THEN 0.0 WHEN var_pop(t_{c}) + var_pop(c_{c}) > 0 "
    f"THEN abs(avg(t_{c}) - avg(c_{c})) / sqrt((var_pop(t_{c}) + var_pop(c_{c})) / 2.0) ELSE 'inf'::DOUBLE END" for c in DID_COVARIATES)
VIEWS["did_effect_v"] = f"""
SELECT b.region, b.treated, b.base, e.matched, e.controls, 100.0 * e.gap AS gap_pt, e.controls - 1 AS df,
  CASE WHEN e.controls > 1 THEN e.gap / nullif(sqrt(v.q * e.controls / (e.controls - 1)) / e.matched, 0) END AS t,
  e.control_growth, e.loss, e.worst_smd, 100.0 * e.loss / nullif(b.base, 0) AS did_pt
FROM (SELECT region, count(*) FILTER (WHERE is_treated) AS treated, sum(pre) AS base FROM units_v GROUP BY 1) b
LEFT JOIN (SELECT region, count(*) AS matched, count(DISTINCT control_id) AS controls, avg(t_growth - c_growth) AS gap,
    avg(c_growth) AS control_growth, sum(t_post - t_pre * (1.0 + c_growth)) AS loss, greatest({_SMD}) AS worst_smd
  FROM did_pair_v GROUP BY 1) e USING (region)
LEFT JOIN (SELECT region, sum(s * s) AS q FROM (
  SELECT p.region, p.control_id, sum(p.t_growth - p.c_growth - m.gap) AS s FROM did_pair_v p
  JOIN (SELECT region, avg(t_growth - c_growth) AS gap FROM did_pair_v GROUP BY 1) m USING (region) GROUP BY 1, 2) GROUP BY 1) v USING (region)
"""


@query("m9_did", f"""
SELECT region, treated, coalesce(matched, 0) AS matched, coalesce(controls, 0) AS controls, round(gap_pt, 6) AS did_pt, round(t, 6) AS t, df,
  round(worst_smd, 6) AS worst_smd, coalesce(worst_smd <= {config.MATCH_MAX_SMD}, false) AS balanced,
  {_p_sql("t", "CAST(df AS DOUBLE)")} <= {config.DID_MAX_P} AND worst_smd <= {config.MATCH_MAX_SMD} AS passed
FROM did_effect_v
""")
def m9(spark, folder):
    found = matched_effect(spark, folder).withColumn("p_value", p_student_t("t", F.col("df").cast("double")))
    even = F.col("worst_smd") <= config.MATCH_MAX_SMD
    none = F.lit(0).cast("long")
    return found.select(
        "region", "treated", F.coalesce("matched", none).alias("matched"), F.coalesce("controls", none).alias("controls"),
        r("gap_pt").alias("did_pt"), r("t"), "df", r("worst_smd"), F.coalesce(even, F.lit(False)).alias("balanced"),
        ((F.col("p_value") <= config.DID_MAX_P) & even).alias("passed"))


DID_SQL = "did_effect_v"


@query("m10_did_region", f"""
SELECT region, round(control_growth, 6) AS control_growth, round(loss / 1e7, 6) AS loss_cr, round(base / 1e7, 6) AS base_cr,
  round(did_pt, 6) AS did_pt FROM {DID_SQL}
""")
def m10(spark, folder):
    return matched_effect(spark, folder).select(
        "region", r("control_growth"), crore(F.col("loss")).alias("loss_cr"), crore(F.col("base")).alias("base_cr"), r("did_pt")
    )


VIEWS["screen_v"] = """
SELECT l.region, l.period, l.hypothesis, string_agg(x.hypothesis, '|' ORDER BY x.hypothesis) AS unresolved
FROM (SELECT * FROM hyp_board_v JOIN hyp_v USING (hypothesis) WHERE live) l
LEFT JOIN hyp_board_v x ON x.region = l.region AND x.period = l.period AND x.live AND NOT x.tested
  AND list_contains(l.confounders, x.hypothesis)
GROUP BY 1, 2, 3
"""


def judged_board(board: DataFrame) -> DataFrame:
    """The board with its templates' rules, confounder screen and test coverage."""
    rules = F.broadcast(config.hypothesis_table(board.sparkSession).drop("hypothesis_no", "prior", "affects"))
    known = causal.missing_sources(board.join(rules, "hypothesis"))
    return causal.test_coverage(causal.confounder_screen(known, CASE), {
        "precedence": F.col("precedence_passed"), "sufficiency": F.coalesce("passed", F.lit(False)),
        "dose_response": F.col("dose_passed"), "specificity": F.col("specificity_passed"),
        "did": F.col("did_significant") & F.col("pretest_passed"),
        "confounder_screen": F.col("live") & ~F.col("screen_failed"),
    })


@query("m11_confounder_screen", """
SELECT region, period, hypothesis, coalesce(unresolved, '') AS unresolved, unresolved IS NOT NULL AS screen_failed FROM screen_v
""")
def m11(spark, folder):
    return judged_board(hypothesis_board(spark, folder)).where("live").select(
        *HYP, F.array_join("unresolved", "|").alias("unresolved"), "screen_failed"
    )


@query("m12_missing_sources", """
SELECT region, period, hypothesis, missing, verifiable FROM hyp_board_v JOIN missing_v USING (hypothesis)
""")
def m12(spark, folder):
    return judged_board(hypothesis_board(spark, folder)).select(
        *HYP, F.array_join("missing", "|").alias("missing"), "verifiable"
    )


VIEWS["result_v"] = """
SELECT b.region, b.period, b.hypothesis, test, CASE test WHEN 'precedence' THEN precedence_passed
  WHEN 'sufficiency' THEN coalesce(impact_share >= 0.3, false) WHEN 'dose_response' THEN dose_passed
  WHEN 'specificity' THEN specificity_passed WHEN 'did' THEN did_significant AND pretest_passed
  ELSE s.hypothesis IS NOT NULL AND s.unresolved IS NULL END AS passed
FROM hyp_board_v b
JOIN (SELECT hypothesis, unnest(applicable_tests) AS test FROM hyp_v) a ON a.hypothesis = b.hypothesis
LEFT JOIN screen_v s ON s.region = b.region AND s.period = b.period AND s.hypothesis = b.hypothesis
"""


@query("m13_test_coverage", """
SELECT region, period, hypothesis, count(*) AS applicable, count(*) FILTER (WHERE passed) AS passed_tests,
  round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM result_v GROUP BY 1, 2, 3
""")
def m13(spark, folder):
    return judged_board(hypothesis_board(spark, folder)).select(*HYP, "applicable", "passed_tests", "coverage")


_ATTRIBUTE_SQL = f"""
(SELECT *, residual_pt - attributed_pt AS unattributed_pt FROM (
  SELECT d.region, d.period, residual_pt, previous, did_pt,
    sign(residual_pt) * CASE WHEN sign(did_pt) = sign(residual_pt) THEN least(abs(did_pt), abs(residual_pt)) ELSE 0.0 END AS attributed_pt
  FROM decomposed_v d JOIN {DID_SQL} x ON x.region = d.region WHERE residual_pt IS NOT NULL
))
"""


@query("m14_attribute", f"""
SELECT region, period, round(attributed_pt, 6) AS attributed_pt,
  round(coalesce(abs(attributed_pt) / nullif(abs(residual_pt), 0), 0.0), 6) AS attributed_share,
  round(unattributed_pt, 6) AS unattributed_pt, round(attributed_pt / 100.0 * previous, 6) AS attributed_value,
  round(unattributed_pt / 100.0 * previous, 6) AS unattributed_value FROM {_ATTRIBUTE_SQL}
""")
def m14(spark, folder):
    effect = matched_effect(spark, folder).select("region", "did_pt")
    cells = decomposed_cells(spark, folder).where("residual_pt IS NOT NULL").join(effect, "region")
    return causal.attribute(cells).select(
        *CASE, r("attributed_pt"), r("attributed_share"), r("unattributed_pt"), r("attributed_value"), r("unattributed_value")
    )


# --- F: confidence to verdict ------------------------------------------------
VIEWS["evid_case_v"] = """
SELECT hypothesis, period, avg(CASE WHEN reliability < 0.6 THEN 1.0 ELSE 0.0 END) AS low_share
FROM evid_v JOIN tier_v USING (kind) GROUP BY 1, 2
"""
VIEWS["evid_contra_v"] = """
SELECT period, count(*) FILTER (WHERE net > 0) > 0 AND count(*) FILTER (WHERE net < 0) > 0 AS contradictory
FROM (SELECT period, source_ref, sum(sign) AS net FROM evid_v GROUP BY 1, 2) GROUP BY 1
"""
VIEWS["evid_hyp_v"] = """
SELECT hypothesis, period, round((sp * up + sn * un) / nullif(CAST((sp + sn) * (up + un) AS DOUBLE), 0), 6) AS concordance FROM (
  SELECT hypothesis, period, count(*) FILTER (WHERE s AND sign = 1) AS sp, count(*) FILTER (WHERE s AND sign = -1) AS sn,
    count(*) FILTER (WHERE NOT s AND sign = 1) AS up, count(*) FILTER (WHERE NOT s AND sign = -1) AS un
  FROM (SELECT *, kind IN ('structured_query', 'derived_estimate') AS s FROM evid_v) GROUP BY 1, 2)
"""
VIEWS["state_v"] = f"""
SELECT source, period, max(loaded_at) AS loaded_at, arg_max(completeness, loaded_at) AS completeness FROM (
  SELECT s.source, c.period, l.loaded_at, l.completeness
  FROM (SELECT unnest({text_list(config.SOURCES)}) AS source) s CROSS JOIN (SELECT DISTINCT CAST(period AS DATE) AS period FROM cells_v) c
  LEFT JOIN loads_v l ON l.source = s.source AND l.loaded_at < c.period + INTERVAL 1 MONTH
) GROUP BY 1, 2
"""
VIEWS["quality_v"] = """
SELECT hypothesis, period, min(CASE WHEN loaded_at IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (96.0 - age) / 72.0)) * completeness END) AS data_quality,
  max(age) AS staleness_hours FROM (
  SELECT h.hypothesis, st.period, st.loaded_at, st.completeness,
    coalesce(round((epoch_us(st.period + INTERVAL 1 MONTH) - epoch_us(st.loaded_at)) / 3.6e9, 6), 'Infinity'::DOUBLE) AS age
  FROM (SELECT hypothesis, unnest(required_sources) AS source FROM hyp_v) h JOIN state_v st USING (source)
) GROUP BY 1, 2
"""
VIEWS["weeks_v"] = """
SELECT region, count(DISTINCT date_trunc('week', txn_date)) AS weeks_held FROM scope_v JOIN stores_v USING (store_id) GROUP BY 1
"""
VIEWS["calib_v"] = """
SELECT hypothesis, count(*) AS closed_cases, avg(CAST(outcome AS DOUBLE)) AS case_type_accuracy FROM ledger_v GROUP BY 1
"""
VIEWS["scored_v"] = f"""
SELECT *, 0.28 * s1 + 0.20 * s2 + 0.16 * s3 + 0.14 * s4 + 0.10 * s5 + 0.12 * s6 AS raw FROM (
  SELECT b.*, c.coverage, 1.0 / (1.0 + exp(-CASE WHEN pretest_passed THEN abs(coalesce(b.did_t, 0.0)) ELSE 0.0 END)) AS s1, c.coverage AS s2, coalesce(e.concordance, 0.0) AS s3,
    greatest(0.0, least(1.0, coalesce(q.data_quality, 0.0))) AS s4,
    greatest(0.0, least(1.0, least(1.0, weeks_held / 52.0) - CASE WHEN abs(headline_pt) >= 50.0 THEN 0.15 ELSE 0.0 END)) AS s5,
    greatest(0.0, least(1.0, coalesce(attributed_share, 0.0))) AS s6,
    coalesce(low_share, 0.0) AS low_share, coalesce(contradictory, false) AS contradictory, coalesce(staleness_hours, 0.0) AS staleness_hours,
    coalesce(closed_cases, 0) AS closed_cases, coalesce(case_type_accuracy, 1.0) AS case_type_accuracy,
    h.verifiable,
    coalesce(sc.unresolved IS NOT NULL, false) AS confounder_screen_failed
  FROM hyp_board_v b JOIN missing_v h USING (hypothesis)
  JOIN (SELECT region, period, hypothesis, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM result_v GROUP BY 1, 2, 3) c
    ON c.region = b.region AND c.period = b.period AND c.hypothesis = b.hypothesis
  JOIN weeks_v w ON w.region = b.region
  LEFT JOIN evid_hyp_v e ON e.hypothesis = b.hypothesis AND e.period = b.period
  LEFT JOIN quality_v q ON q.hypothesis = b.hypothesis AND q.period = b.period
  LEFT JOIN evid_case_v ec ON ec.hypothesis = b.hypothesis AND ec.period = b.period
  LEFT JOIN evid_contra_v ct ON ct.period = b.period
  LEFT JOIN calib_v k ON k.hypothesis = b.hypothesis
  LEFT JOIN screen_v sc ON sc.region = b.region AND sc.period = b.period AND sc.hypothesis = b.hypothesis
  WHERE b.live
)
"""
VIEWS["capped_v"] = """
SELECT *, least(raw, CASE WHEN confounder_screen_failed THEN 0.85 ELSE 1.0 END, CASE WHEN NOT verifiable THEN 0.45 ELSE 1.0 END,
  CASE WHEN NOT precedence_passed THEN 0.0 ELSE 1.0 END, CASE WHEN low_share > 0.5 THEN 0.65 ELSE 1.0 END) AS after_caps
FROM scored_v
"""
VIEWS["leading_v"] = """
SELECT *, coalesce(round(separation, 9) <= 0.10, false) AS near_tie FROM (
  SELECT *, confidence - lead(confidence) OVER w AS separation, row_number() OVER w AS place
  FROM (SELECT *, round(after_caps, 6) AS confidence FROM capped_v)
  WINDOW w AS (PARTITION BY region, period ORDER BY confidence DESC, hypothesis)
) WHERE place = 1
"""


def ledger(spark, folder) -> DataFrame:
    """Closed cases: hypothesis, score, outcome."""
    documents = tables.read_table(spark, folder, "documents").select("doc_id", "n_chars")
    names = F.array(*map(F.lit, config.HYPOTHESES))
    return tables.read_table(spark, folder, "labels").join(documents, "doc_id").select(
        F.element_at(names, (F.col("doc_id") % len(config.HYPOTHESES) + 1).cast("int")).alias("hypothesis"),
        F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), F.col("quality").alias("outcome"),
    )


def source_quality(spark, folder, cases: DataFrame) -> DataFrame:
    """Worst required source of each hypothesis, by name, as the sources stood at the end of the case's month."""
    spec = config.KPIS["net_revenue"]
    names = F.array(*map(F.lit, config.SOURCES))
    known = spark.range(1).select(F.explode(names).alias("source"))
    states = confidence.source_states(standins.source_loads(spark, folder), known, cases)
    return confidence.required_quality(
        states, config.hypothesis_table(spark), spec["freshness_full_hours"], spec["freshness_zero_hours"])


@query("f1_source_quality", """
SELECT hypothesis, period, round(data_quality, 6) AS data_quality,
  CASE WHEN staleness_hours < 'Infinity'::DOUBLE THEN round(staleness_hours, 6) END AS staleness_hours FROM quality_v
""")
def f1_quality(spark, folder):
    """Null staleness: a required source has never loaded."""
    return source_quality(spark, folder, region_cells(spark, folder)).select(
        "hypothesis", "period", r("data_quality"),
        F.when(F.col("staleness_hours") < float("inf"), F.round("staleness_hours", 6)).alias("staleness_hours"))


def scored_hypotheses(spark, folder, sums: DataFrame | None = None) -> DataFrame:
    """Live hypotheses of every cell with their components and raw confidence."""
    items = standins.evidence(spark, folder)
    case_keys = ["hypothesis", "period"]
    slices = store_slices(spark, folder, sums)
    parts = slice_months(slices)
    board = judged_board(hypothesis_board(spark, folder, slices, parts)).where("live")
    signals = evidence.case_signals(items, config.reliability_table(spark), case_keys).drop("contradictory")
    agree = evidence.concordance(items, case_keys).select(*case_keys, "concordance")
    # Contradiction is judged over all evidence of a case, whatever it is about.
    against = evidence.contradictions(items, ["period"]).select("period", "contradictory")
    closed = ledger(spark, folder).groupBy("hypothesis").agg(
        F.count(F.lit(1)).alias("closed_cases"), F.avg(F.col("outcome").cast("double")).alias("case_type_accuracy")
    )
    weeks = gates.weeks_held(parts, REGION, "period", "weeks")
    case = (
        board.join(weeks, "region")
        .join(agree, case_keys, "left").join(source_quality(spark, folder, parts), case_keys, "left")
        .join(signals, case_keys, "left").join(against, "period", "left").join(closed, "hypothesis", "left")
        .withColumn("t", F.when(F.col("pretest_passed"), F.col("did_t")))  # a failed pre-test leaves the estimate without weight
        .withColumn("regime_change", F.abs("headline_pt") >= 50.0)
        .withColumn("low_share", F.coalesce("low_share", F.lit(0.0)))
        .withColumn("contradictory", F.coalesce("contradictory", F.lit(False)))
        .withColumn("staleness_hours", F.coalesce("staleness_hours", F.lit(0.0)))
        .withColumn("closed_cases", F.coalesce("closed_cases", F.lit(0)))
        .withColumn("case_type_accuracy", F.coalesce("case_type_accuracy", F.lit(1.0)))
    )
    return written(confidence.raw_confidence(confidence.components(case)), "scored")


def capped_hypotheses(scored: DataFrame) -> DataFrame:
    flagged = scored.select(
        "*",
        F.col("screen_failed").alias("confounder_screen_failed"),
        (~F.col("verifiable")).alias("required_source_missing"),
        (~F.col("precedence_passed")).alias("temporal_precedence_failed"),
        (F.col("low_share") > config.TRIGGERS["max_low_reliability_share"]).alias("low_reliability_dominated"),
    )
    return confidence.apply_caps(flagged)


def leading_cases(scored: DataFrame) -> DataFrame:
    capped = capped_hypotheses(scored).withColumn("confidence", rounded(F.col("after_caps")))
    return confidence.leading(capped, CASE, "confidence")


@query("f1_components", """
SELECT region, period, hypothesis, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3, round(s4, 6) AS s4,
  round(s5, 6) AS s5, round(s6, 6) AS s6 FROM scored_v
""")
def f1(spark, folder):
    return scored_hypotheses(spark, folder).select(*HYP, *[r(c) for c in config.COMPONENT_WEIGHTS])


@query("f2_raw_confidence", "SELECT region, period, hypothesis, round(raw, 6) AS raw FROM scored_v")
def f2(spark, folder):
    return scored_hypotheses(spark, folder).select(*HYP, r("raw"))


@query("f3_caps", """
SELECT region, period, hypothesis, round(raw, 6) AS raw, round(after_caps, 6) AS after_caps, NOT precedence_passed AS eliminated,
  concat_ws('|', CASE WHEN confounder_screen_failed THEN 'confounder_screen_failed' END,
    CASE WHEN NOT verifiable THEN 'required_source_missing' END,
    CASE WHEN NOT precedence_passed THEN 'temporal_precedence_failed' END,
    CASE WHEN low_share > 0.5 THEN 'low_reliability_dominated' END) AS caps_fired,
  CASE WHEN NOT verifiable THEN 'T3' ELSE '' END AS forced_triggers FROM capped_v
""")
def f3(spark, folder):
    return capped_hypotheses(scored_hypotheses(spark, folder)).select(
        *HYP, r("raw"), r("after_caps"), "eliminated", F.array_join("caps_fired", "|").alias("caps_fired"),
        F.array_join("forced_triggers", "|").alias("forced_triggers"),
    )


# The isotonic mean at a score is the largest, over starts at or below it, of the
# smallest mean of cases from there to any end at or above it.
VIEWS["iso_v"] = """
SELECT p.hypothesis, p.score, p.label, p.cases, b.calibrated FROM (
  SELECT hypothesis, score, avg(CAST(outcome AS DOUBLE)) AS label, count(*) AS cases FROM ledger_v GROUP BY 1, 2) p
JOIN (
  SELECT hypothesis, score, max(low) AS calibrated FROM (
    SELECT hypothesis, first, score, min(mean) OVER (PARTITION BY hypothesis, first ORDER BY score DESC) AS low FROM (
      SELECT a.hypothesis, a.score AS first, b.score, sum(b.ones) OVER w / sum(b.cases) OVER w AS mean
      FROM (SELECT DISTINCT hypothesis, score FROM ledger_v) a JOIN (
        SELECT hypothesis, score, CAST(count(*) AS DOUBLE) AS cases, sum(CAST(outcome AS DOUBLE)) AS ones FROM ledger_v GROUP BY 1, 2) b
        ON b.hypothesis = a.hypothesis AND b.score >= a.score WINDOW w AS (PARTITION BY a.hypothesis, a.score ORDER BY b.score)))
  GROUP BY 1, 2) b USING (hypothesis, score)
"""


def closed_case_curve(spark, folder) -> DataFrame:
    return confidence.calibration_curve(ledger(spark, folder), ["hypothesis"], "hypothesis string", "score", "outcome")


@query("f4_calibrate", "SELECT hypothesis, score, round(label, 6) AS label, cases, round(calibrated, 6) AS calibrated FROM iso_v")
def f4(spark, folder):
    """The curve of each case type, read off at the scores of its closed cases."""
    closed = ledger(spark, folder).groupBy("hypothesis", "score").agg(
        F.avg(F.col("outcome").cast("double")).alias("label"), F.count(F.lit(1)).alias("cases"))
    read = confidence.calibrated(closed, closed_case_curve(spark, folder), ["hypothesis"], "score", 1)
    return read.select("hypothesis", "score", r("label"), "cases", r("calibrated"))


_REPORT_SQL = """
(SELECT hypothesis, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS cases, avg(score) AS mean_score,
  avg(CAST(outcome AS DOUBLE)) AS accuracy FROM ledger_v GROUP BY 1, 2)
"""


@query("f5_calibration_report", f"""
SELECT hypothesis, bin, cases, round(mean_score, 6) AS mean_score, round(accuracy, 6) AS accuracy,
  round(abs(mean_score - accuracy), 6) AS gap, cases >= 5 AS enough_cases FROM {_REPORT_SQL}
""")
def f5(spark, folder):
    return confidence.calibration_report(ledger(spark, folder), ["hypothesis"], "score", "outcome").select(
        "hypothesis", "bin", "cases", r("mean_score"), r("accuracy"), r("gap"), "enough_cases"
    )


@query("f5_expected_calibration_error", f"""
SELECT *, ece <= 0.05 AND accuracy >= 0.70 AND cases >= 5 AS publishable FROM (
  SELECT hypothesis, CAST(sum(cases) AS BIGINT) AS cases, round(sum(abs(mean_score - accuracy) * cases) / sum(cases), 6) AS ece,
    round(sum(accuracy * cases) / sum(cases), 6) AS accuracy FROM {_REPORT_SQL} GROUP BY 1)
""")
def f5_ece(spark, folder):
    report = confidence.calibration_report(ledger(spark, folder), ["hypothesis"], "score", "outcome")
    return confidence.expected_calibration_error(report, ["hypothesis"])


VIEWS["trigger_v"] = """
SELECT *, concat_ws('+', CASE WHEN T1 THEN 'T1' END, CASE WHEN T2 THEN 'T2' END, CASE WHEN T3 THEN 'T3' END, CASE WHEN T4 THEN 'T4' END,
  CASE WHEN T5 THEN 'T5' END, CASE WHEN T6 THEN 'T6' END, CASE WHEN T7 THEN 'T7' END, CASE WHEN T8 THEN 'T8' END) AS triggers_fired
FROM (
  SELECT *, NOT (precedence_passed AND coalesce(impact_share >= 0.3, false)) AS T1, s6 < 0.30 AS T2, NOT verifiable AS T3,
    near_tie AS T4, contradictory AS T5, low_share > 0.5 AS T6, closed_cases >= 5 AND case_type_accuracy < 0.70 AS T7,
    staleness_hours > 48 AS T8 FROM leading_v
)
"""


def triggered_cases(scored: DataFrame) -> DataFrame:
    lead = leading_cases(scored).withColumn(
        "hard_gates_passed", F.col("precedence_passed") & F.coalesce("passed", F.lit(False))
    )
    return confidence.triggers(lead)


@query("f6_triggers", """
SELECT region, period, hypothesis, T1, T2, T3, T4, T5, T6, T7, T8, triggers_fired FROM trigger_v
""")
def f6(spark, folder):
    return triggered_cases(scored_hypotheses(spark, folder)).select(
        *HYP, *[f"T{i}" for i in range(1, 9)], F.array_join("triggers_fired", "+").alias("triggers_fired")
    )


VIEWS["published_v"] = f"""
SELECT t.* EXCLUDE (confidence), t.confidence AS capped, round(CASE WHEN coalesce(n.calibration_cases, 0) < {config.CALIBRATION["min_cases"]} THEN t.confidence
    ELSE least(coalesce((SELECT arg_max(i.calibrated, i.score) FROM iso_v i WHERE i.hypothesis = t.hypothesis AND i.score <= t.confidence), n.lowest),
      CASE WHEN confounder_screen_failed THEN 0.85 ELSE 1.0 END, CASE WHEN NOT verifiable THEN 0.45 ELSE 1.0 END,
      CASE WHEN NOT precedence_passed THEN 0.0 ELSE 1.0 END, CASE WHEN low_share > 0.5 THEN 0.65 ELSE 1.0 END) END, 6) AS confidence
FROM trigger_v t LEFT JOIN (SELECT hypothesis, CAST(sum(cases) AS BIGINT) AS calibration_cases, arg_min(calibrated, score) AS lowest FROM iso_v GROUP BY 1) n
  ON n.hypothesis = t.hypothesis
"""
VIEWS["verdict_v"] = """
SELECT *, CASE WHEN triggers_fired <> '' THEN 'INSUFFICIENT_EVIDENCE'
    WHEN s6 >= 0.70 AND confidence >= 0.70 AND NOT blocked THEN 'EXPLAINED'
    WHEN s6 >= 0.30 AND confidence >= 0.60 THEN 'PARTIALLY_EXPLAINED' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict,
  CASE WHEN triggers_fired <> '' THEN triggers_fired WHEN s6 >= 0.70 AND confidence >= 0.70 AND NOT blocked THEN NULL
    WHEN s6 >= 0.30 AND confidence >= 0.60 AND blocked THEN 'live_unverifiable_above_materiality'
    WHEN s6 < 0.70 THEN 'coverage_below_threshold' ELSE 'confidence_below_threshold' END AS reason_code
FROM (
  SELECT t.*, coalesce(u.held, 0.0) > 0.5 AS blocked FROM published_v t LEFT JOIN (
    SELECT region, period, max(attributed_share * abs(residual_pt) / 100.0 * cell_previous) AS held
    FROM scored_v WHERE NOT verifiable GROUP BY 1, 2
  ) u ON u.region = t.region AND u.period = t.period
)
"""


def verdict_cases(spark, folder) -> DataFrame:
    """What the evidence says of every cell (``judged``), and the verdict, which
    only a cell that passes every gate gets; the others name their gate.  An
    unverifiable live rival holding more than the materiality limit blocks a
    full explanation."""
    sums = slice_sums(spark, folder)
    scored = scored_hypotheses(spark, folder, sums)
    curve = written(closed_case_curve(spark, folder), "calibration-curve")
    held = F.col("attributed_share") * F.abs("residual_pt") / 100.0 * F.col("cell_previous")
    rivals = scored.where(~F.col("verifiable")).groupBy(*CASE).agg(F.max(held).alias("held"))
    limit = config.KPIS["net_revenue"]["materiality"]
    # The published confidence is calibrated on closed cases of its kind; a cap holds for it as well.
    published = confidence.calibrated(triggered_cases(scored).drop("calibrated"), curve, ["hypothesis"], "confidence").withColumnRenamed(
        "confidence", "capped").withColumn("confidence", rounded(F.least("calibrated", "ceiling")))
    case = published.join(rivals, CASE, "left").withColumn(
        "unverifiable_above_materiality", F.coalesce("held", F.lit(0.0)) > limit
    ).withColumn("coverage", F.col("s6"))
    # The slices of a store add up to its months, so the gates don't scan the facts for them.
    per_store = sums.groupBy("store_id", "period").agg(
        F.sum("net").alias("net"), F.bit_or("weeks").alias("weeks"), *baseline.moment_totals(FESTIVAL_SPANS))
    gate = gated_cells(spark, folder, revenue_only=True, per_store=per_store).select(*CASE, F.col("outcome").alias("gate"))
    judged = confidence.verdict(case).withColumnRenamed("verdict", "judged").join(gate, CASE, "left")
    return judged.withColumn("verdict", F.when(F.col("gate").isNull(), F.col("judged")))


@query("f7_verdict", """
SELECT v.region, v.period, hypothesis, round(s6, 6) AS coverage, capped, confidence, verdict AS judged, reason_code,
  CASE gate_id WHEN 1 THEN 'DATA_INCIDENT' WHEN 2 THEN 'IMMATERIAL' WHEN 3 THEN 'INSUFFICIENT_HISTORY'
    WHEN 4 THEN 'NOT_AUTHORISED' WHEN 5 THEN 'NOT_PERSISTENT' END AS gate,
  CASE WHEN gate_id IS NULL THEN verdict END AS verdict
FROM verdict_v v JOIN gated_v g ON g.kpi = 'net_revenue' AND g.region = v.region AND g.period = v.period
""")
def f7(spark, folder):
    return verdict_cases(spark, folder).select(
        *HYP, r("coverage"), "capped", "confidence", "judged", "reason_code", "gate", "verdict")


@query("f8_leading", """
SELECT region, period, hypothesis, confidence, round(separation, 6) AS separation, near_tie FROM leading_v
""")
def f8(spark, folder):
    return leading_cases(scored_hypotheses(spark, folder)).select(*HYP, "confidence", r("separation"), "near_tie")


# --- R: recommendations -------------------------------------------------------
VIEWS["action_v"] = """
SELECT *, attributable_loss * p25 AS recovery_low, attributable_loss * p75 AS recovery_high FROM (
  SELECT s.region, s.period, s.hypothesis, s.region || '/' || CAST(s.period AS VARCHAR) || '/' || s.hypothesis AS case_id, p.*,
    s.precedence_passed, s.confidence, coalesce(x.price_effect > 0, false) AS price_event,
    coalesce(100.0 * x.price_effect / nullif(x.asp_before, 0), 0.0) AS price_effect_pct,
    s6 * abs(residual_pt) / 100.0 * cell_previous * 1e7 AS attributable_loss,
    fixed_cost + CASE cost_type WHEN 'per_store_unit_cost' THEN unit_cost * CASE scales_with WHEN 'treated_store_count' THEN treated
        WHEN 'uninstrumented_store_count' THEN uninstrumented WHEN 'affected_store_count' THEN total END
        * CASE WHEN cost_unit = 'store_week' THEN horizon_weeks ELSE 1 END
      WHEN 'annual_subscription' THEN unit_cost WHEN 'margin_forgone' THEN greatest(coalesce(x.price_effect / nullif(x.asp_before, 0), 0.0), 0.0)
        * volume_share * cell_value * 1e7 END AS cost_inr,
    max(round(after_caps, 6)) OVER (PARTITION BY s.region, s.period) AS best_confidence
  FROM (SELECT *, round(after_caps, 6) AS confidence FROM capped_v) s
  JOIN (SELECT region, count(*) FILTER (WHERE is_treated) AS treated, count(*) FILTER (WHERE NOT has_footfall_counter) AS uninstrumented,
      count(*) AS total FROM stores_v GROUP BY 1) g ON g.region = s.region
  LEFT JOIN book_v p ON p.driver = s.hypothesis
  LEFT JOIN price_mix_v x ON x.region = s.region AND x.period = s.period
) WHERE playbook IS NOT NULL
"""


def action_board(spark, folder) -> DataFrame:
    """Live hypotheses with a playbook, with the quantities their costs scale with.

    The price event and its depth are the price part of the region's change in
    selling price, with the mix held.
    """
    price_parts = region_price_mix(spark, folder).select(*CASE, "price_effect", "asp_before")
    stores = standins.stores(spark, folder).groupBy("region").agg(
        F.count_if(F.col("is_treated")).alias("treated_stores"),
        F.count_if(~F.col("has_footfall_counter")).alias("uninstrumented_stores"),
        F.count(F.lit(1)).alias("affected_stores"),
    )
    case = (
        capped_hypotheses(scored_hypotheses(spark, folder))
        .withColumn("confidence", rounded(F.col("after_caps")))
        .withColumn("best_confidence", F.max("confidence").over(Window.partitionBy(*CASE)))
        .join(stores, "region")
        .withColumn("driver", F.col("hypothesis"))
        .withColumn("case_id", F.concat_ws("/", "region", F.col("period").cast("string"), "hypothesis"))
        .join(price_parts, CASE, "left")
        .withColumn("price_change", F.coalesce(ratio(F.col("price_effect"), F.col("asp_before")), F.lit(0.0)))
        .withColumn("depth", F.greatest("price_change", F.lit(0.0)))  # what a rollback would take back
        .withColumn("affected_revenue", F.col("volume_share") * F.col("cell_value") * config.CRORE)
        .withColumn("attributable_loss",
                    F.col("s6") * F.abs("residual_pt") / 100.0 * F.col("cell_previous") * config.CRORE)
    )
    costed = actions.action_cost(actions.with_playbook(case, config.playbook_table(spark)))
    return actions.roi(actions.recovery_range(costed))


@query("r1_action_cost", """
SELECT case_id, playbook, cost_type, round(cost_inr / 1e5, 4) AS cost_lakh FROM action_v
""")
def r1(spark, folder):
    return action_board(spark, folder).select(
        "case_id", "playbook", "cost_type", F.round(F.col("cost_inr") / config.LAKH, 4).alias("cost_lakh")
    )


@query("r2_recovery_range", """
SELECT case_id, playbook, round(recovery_low / 1e7, 6) AS recovery_low_cr, round(recovery_high / 1e7, 6) AS recovery_high_cr FROM action_v
""")
def r2(spark, folder):
    return action_board(spark, folder).select(
        "case_id", "playbook", crore(F.col("recovery_low")).alias("recovery_low_cr"),
        crore(F.col("recovery_high")).alias("recovery_high_cr"),
    )


@query("r3_roi", """
SELECT case_id, playbook, round(recovery_low / nullif(cost_inr, 0), 6) AS roi_low, round(recovery_high / nullif(cost_inr, 0), 6) AS roi_high FROM action_v
""")
def r3(spark, folder):
    return action_board(spark, folder).select("case_id", "playbook", r("roi_low"), r("roi_high"))


@query("r4_rank_actions", """
SELECT region, period, playbook, CAST(place AS INTEGER) AS place, round(roi_low, 6) AS roi_low FROM (
  SELECT *, row_number() OVER (PARTITION BY region, period ORDER BY roi_low DESC NULLS LAST, playbook) AS place
  FROM (SELECT *, recovery_low / nullif(cost_inr, 0) AS roi_low FROM action_v)
) WHERE place <= 3
""")
def r4(spark, folder):
    return actions.rank_actions(action_board(spark, folder), CASE).select(*CASE, "playbook", "place", r("roi_low"))


@query("r5_checkpoints", """
SELECT case_id, playbook, primary_kpi, CAST(at_week AS INTEGER) AS at_week, period + CAST(at_week * 7 AS INTEGER) AS due_date
FROM (SELECT *, unnest(checkpoints) AS at_week FROM action_v)
""")
def r5(spark, folder):
    return actions.checkpoints(action_board(spark, folder), "period").select(
        "case_id", "playbook", "primary_kpi", "at_week", "due_date"
    )


@query("r6_eligible_actions", """
SELECT case_id, playbook, cost_type <> 'margin_forgone' OR coalesce(price_event AND precedence_passed
  AND price_effect_pct >= 2.0 AND confidence >= best_confidence, false) AS eligible FROM action_v
""")
def r6(spark, folder):
    case = (
        action_board(spark, folder)
        .withColumn("price_event_confirmed", F.col("price_effect") > 0)
        .withColumn("mix_adjusted_material", 100.0 * F.col("price_change") >= config.KPIS["avg_selling_price"]["materiality"])
        .withColumn("no_stronger_rival", F.col("confidence") >= F.col("best_confidence"))
    )
    return actions.eligible_actions(case).select("case_id", "playbook", "eligible")


@query("r7_linked_cases", """
SELECT case_id AS origin_case, case_id || '/' || linked_driver AS linked_case, linked_driver AS hypothesis,
  linked_scope AS scope_hint, linked_rationale AS rationale FROM action_v
""")
def r7(spark, folder):
    return actions.linked_cases(action_board(spark, folder), "case_id")
