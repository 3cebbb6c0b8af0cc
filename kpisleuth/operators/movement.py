"""Movement, baseline and residual.

Windows here run over one row per period of one series.  A series has at most
one row per calendar day, so a window partition stays small whatever the size
of the facts behind it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import previous_by_period, ratio, spread_by
from kpisleuth.functions.scale import competition_rank


def movement(cells: DataFrame, keys: list[str], months: int = 1) -> DataFrame:
    """Change against the same key one period earlier; null across gaps."""
    before = previous_by_period(F.col("value"), keys, "period", months)
    return (
        cells.withColumn("previous", before)
        .withColumn("delta", F.col("value") - F.col("previous"))
        .withColumn("delta_pct", 100.0 * ratio(F.col("delta"), F.col("previous")))
    )


def trailing_expected(cells: DataFrame, keys: list[str], periods: int = 12, additive: Column | None = None) -> DataFrame:
    """Expected value: mean daily level of the trailing periods times the days
    in the month; where ``additive`` is false (a rate or a price), the mean
    level itself.  Null until a full run of periods is held."""
    days = F.dayofmonth(F.last_day("period"))
    if additive is not None:
        days = F.when(additive, days).otherwise(1)
    run = Window.partitionBy(*keys).orderBy("period").rowsBetween(-periods, -1)
    held = F.count("value").over(run) == periods
    level = F.avg(F.col("value") / days).over(run)
    return cells.withColumn("expected", F.when(held, level * days))


def decompose(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Headline, calendar and residual, in points and in the value's unit."""
    moved = movement(cells, keys)
    calendar = 100.0 * (ratio(F.col("expected"), F.col("previous")) - 1.0)
    return (
        moved.withColumn("headline_pt", F.col("delta_pct"))
        .withColumn("calendar_pt", calendar)
        .withColumn("residual_pt", F.col("headline_pt") - F.col("calendar_pt"))
        .withColumn("calendar_value", F.col("calendar_pt") / 100.0 * F.col("previous"))
        .withColumn("residual_value", F.col("residual_pt") / 100.0 * F.col("previous"))
    )


def residual_strip(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(actual - expected) over the previous actual, per scope."""
    before = previous_by_period(F.col("value"), keys, "period")
    return cells.withColumn("previous", before).withColumn(
        "strip_pt", 100.0 * ratio(F.col("value") - F.col("expected"), F.col("previous"))
    )


def growth_residual(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Actual growth less expected growth, each on its own denominator; a flat
    month that should have risen shows up here."""
    before = previous_by_period(F.col("value"), keys, "period")
    expected_before = previous_by_period(F.col("expected"), keys, "period")
    actual = 100.0 * (ratio(F.col("value"), before) - 1.0)
    expected = 100.0 * (ratio(F.col("expected"), expected_before) - 1.0)
    return (
        cells.withColumn("actual_growth_pt", actual)
        .withColumn("expected_growth_pt", expected)
        .withColumn("growth_residual_pt", F.col("actual_growth_pt") - F.col("expected_growth_pt"))
    )


def seasonal_baseline(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Classical weekly decomposition: centred 7-day mean plus weekday effect.

    ``daily`` is dense (one row per day).  Days without a full window have no
    trend and therefore no baseline.
    """
    half = config.KPIS["net_revenue"]["seasonal_period_days"] // 2
    run = Window.partitionBy(*keys).orderBy("date").rowsBetween(-half, half)
    full = F.count("value").over(run) == 2 * half + 1
    trended = daily.withColumn("trend", F.when(full, F.avg("value").over(run))).withColumn(
        "dow", F.weekday("date")
    )
    effect = F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy(*keys, "dow"))
    return (
        trended.withColumn("seasonal", effect)
        .withColumn("baseline", F.col("trend") + F.col("seasonal"))
        .withColumn("residual", F.col("value") - F.col("baseline"))
    )


def _loess(x: np.ndarray, values: np.ndarray, span: int) -> np.ndarray:
    """Local linear fit with tricube weights at every point; ``x`` ascends."""
    n = len(values)
    span = min(span, n)
    fitted = np.empty(n)
    for i in range(n):
        first = min(max(i - span // 2, 0), n - span)
        at = slice(first, first + span)
        reach = max(abs(x[at] - x[i]).max(), 1.0)
        weight = (1.0 - (np.abs(x[at] - x[i]) / (reach * 1.0001)) ** 3) ** 3
        total = weight.sum()
        mx, my = (weight * x[at]).sum() / total, (weight * values[at]).sum() / total
        spread = (weight * (x[at] - mx) ** 2).sum()
        slope = (weight * (x[at] - mx) * (values[at] - my)).sum() / spread if spread > 0 else 0.0
        fitted[i] = my + slope * (x[i] - mx)
    return fitted


def loess_baseline(daily: DataFrame, keys: list[str], key_schema: str, span: int = 29, rounds: int = 2) -> DataFrame:
    """Seasonal-trend split with LOESS smoothing, one series per group.

    ``daily`` holds one row per day of a series, so a group is bounded by the
    number of calendar days; the series themselves spread over the cluster.
    """
    period = config.KPIS["net_revenue"]["seasonal_period_days"]
    out = [*keys, "date", "value", "trend", "seasonal", "residual"]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable").reset_index(drop=True)
        value = pdf["value"].to_numpy(dtype=float)
        known = np.isfinite(value)
        phase = pd.to_datetime(pdf["date"]).dt.dayofweek.to_numpy()
        trend = np.zeros(len(value))
        seasonal = np.zeros(len(value))
        for _ in range(rounds if known.any() else 0):
            means = np.array([
                (value - trend)[known & (phase == d)].mean() if (known & (phase == d)).any() else 0.0 for d in range(period)
            ])
            seasonal = (means - means.mean())[phase]
            # Fitted on known days, read off between them elsewhere.
            days = np.flatnonzero(known)
            trend = np.interp(np.arange(len(value)), days, _loess(days.astype(float), (value - seasonal)[known], span))
        pdf["trend"], pdf["seasonal"] = trend, seasonal
        pdf["residual"] = value - trend - seasonal
        return pdf[out]

    schema = f"{key_schema}, date date, value double, trend double, seasonal double, residual double"
    return spread_by(daily.select(*keys, "date", "value"), keys).groupBy(*keys).applyInPandas(split, schema)


def flag_regression(daily: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """One-flag calendar regression by the built-in regression aggregates."""
    x = F.when(F.col(flag), 1.0).otherwise(0.0)
    return daily.groupBy(*keys).agg(
        F.regr_slope(F.col("value"), x).alias("effect"),
        F.regr_intercept(F.col("value"), x).alias("level"),
        F.regr_r2(F.col("value"), x).alias("r2"),
    )


def calendar_regression(daily: DataFrame, keys: list[str], key_schema: str, flags: list[str]) -> DataFrame:
    """Least squares on several flags.

    Normal-equation sums come from one aggregate, so no series is gathered; the
    small system of each series is solved in Arrow batches of finished sums.
    """
    terms = {"intercept": F.lit(1.0), **{f: F.when(F.col(f), 1.0).otherwise(0.0) for f in flags}}
    names = list(terms)
    sums = [F.sum(terms[a] * terms[b]).alias(f"x_{i}_{j}")
            for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(terms[a] * F.col("value")).alias(f"y_{i}") for i, a in enumerate(names)]
    normal = daily.where(F.col("value").isNotNull()).groupBy(*keys).agg(*sums)
    size = len(names)

    def solve(batches):
        for pdf in batches:
            matrix = np.empty((len(pdf), size, size))
            right = np.empty((len(pdf), size))
            for i in range(size):
                right[:, i] = pdf[f"y_{i}"]
                for j in range(i, size):
                    matrix[:, i, j] = matrix[:, j, i] = pdf[f"x_{i}_{j}"]
            solution = np.stack([np.linalg.pinv(m) @ r for m, r in zip(matrix, right, strict=True)]) \
                if len(pdf) else np.empty((0, size))
            out = pdf[keys].copy()
            for i, name in enumerate(names):
                out[f"b_{name}"] = solution[:, i]
            yield out

    schema = key_schema + "".join(f", b_{n} double" for n in names)
    return normal.mapInPandas(solve, schema)


def festival_factor(days: DataFrame, windows: DataFrame, intensity: DataFrame, amplitude: float) -> DataFrame:
    """Multiplicative festival demand per region and day.

    Inside a window demand ramps to the festival's own peak position; after it
    a hangover decays over seven days.  Overlapping festivals multiply.
    """
    span = F.datediff("window_end", "window_start") + 1
    offset = F.datediff("date", "window_start")
    position = (offset + 1) / (span + 1)
    remapped = F.when(position <= F.col("peak"), 0.5 * position / F.col("peak")).otherwise(
        0.5 + 0.5 * (position - F.col("peak")) / (1.0 - F.col("peak"))
    )
    after = F.datediff("date", "window_end")
    decay = (config.HANGOVER_DAYS + 1 - after) / float(config.HANGOVER_DAYS + 1)
    strength = F.lit(amplitude) * F.col("intensity")
    factor = F.when(after <= 0, 1.0 + strength * F.sin(F.pi() * remapped)).otherwise(
        1.0 - F.lit(config.HANGOVER_DEPTH) * strength * decay
    )
    touched = windows.withColumn(
        "date", F.explode(F.sequence("window_start", F.date_add("window_end", config.HANGOVER_DAYS)))
    )
    effects = (
        touched.join(intensity.where(F.col("intensity") > 0), "festival")
        .groupBy("region", "date")
        .agg(F.exp(F.sum(F.ln(factor))).alias("factor"))
    )
    regions = intensity.select("region").distinct()
    spine = regions.select("region", F.lit(True).alias("_r")).join(
        F.broadcast(days.groupBy().agg(F.min("date").alias("a"), F.max("date").alias("b")))
    ).select("region", F.explode(F.sequence("a", "b")).alias("date"))
    return spine.join(F.broadcast(effects), ["region", "date"], "left").select(
        "region", "date", F.coalesce("factor", F.lit(1.0)).alias("factor")
    )


def residual_band(residuals: DataFrame, keys: list[str], kpi: str) -> DataFrame:
    """Quantile of |residual| over the trailing weeks, per series and week."""
    spec = config.KPIS[kpi]
    weeks = spec["band_lookback_weeks"]
    index = F.floor(F.datediff("period", F.lit("1970-01-05").cast("date")) / 7).cast("long")
    trailing = Window.partitionBy(*keys).orderBy("week_index").rangeBetween(-weeks, -1)
    size = F.abs(F.col("residual"))
    return (
        residuals.withColumn("week_index", index)
        .withColumn("band", F.percentile(size, F.lit(spec["band_quantile"])).over(trailing))
        .withColumn("weeks_held", F.count("residual").over(trailing))
        .withColumn("breach", size > F.col("band"))
    )


def price_mix(parts: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Split a change in average price into price (mix held) and mix.

    ``parts`` has ``net`` and ``units`` per key, item and period.  Items sold in
    one period only carry no price effect.
    """
    order = Window.partitionBy(*keys, "period")
    shares = (
        parts.withColumn("price", ratio(F.col("net"), F.col("units")))
        .withColumn("share", ratio(F.col("units"), F.sum("units").over(order)))
    )
    price0 = previous_by_period(F.col("price"), [*keys, item], "period")
    share0 = previous_by_period(F.col("share"), [*keys, item], "period")
    effect = (
        shares.withColumn("_p0", price0).withColumn("_s0", share0)
        .groupBy(*keys, "period")
        .agg(
            F.sum(F.coalesce((F.col("price") - F.col("_p0")) * F.col("_s0"), F.lit(0.0))).alias("price_effect"),
            ratio(F.sum("net"), F.sum("units")).alias("asp"),
        )
    )
    before = previous_by_period(F.col("asp"), keys, "period")
    return (
        effect.withColumn("asp_before", before)
        .where(F.col("asp_before").isNotNull())
        .withColumn("asp_delta", F.col("asp") - F.col("asp_before"))
        .withColumn("mix_effect", F.col("asp_delta") - F.col("price_effect"))
    )


def rank_cells(cells: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rank scopes inside a period, worst residual first; ties share a rank."""
    return competition_rank(cells, group, value, name, descending=False)


def weekly(daily: DataFrame, keys: list[str], value: str) -> DataFrame:
    return daily.groupBy(*keys, F.date_trunc("week", "date").cast("date").alias("period")).agg(
        F.sum(value).alias(value), F.count(value).alias("days")
    )

