"""The contract's expected value: trend, weekday and calendar flags by least squares.

The normal equations split in two.  What depends on the facts is linear in them,
so every line adds its amount times each term of its day, and those sums ride
along in the one aggregate that makes the cells.  What depends on the calendar
alone comes from the days, a few thousand whatever the facts.  Each month is
predicted from the months before it, never from itself; a month's prediction is
the sum of the predictions of its days, days without sales counting as zero.
"""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpisleuth import config
from kpisleuth.functions.columns import rounded, spread_by

Span = tuple[date, date]
TREND_ORIGIN = date(1995, 1, 1)
RIDGE = 1e-3  # of a day: holds a flag that never occurred at zero


def terms(day: Column, festivals: list[Span]) -> dict[str, Column]:
    """Value of each term on a day.  Monday is the level; the weekend flag carries Sunday."""
    one = lambda flag: F.when(flag, 1.0).otherwise(0.0)
    weekday = {name: one(F.weekday(day) == n) for n, name in enumerate(("tue", "wed", "thu", "fri", "sat"), 1)}
    # One look into a set of days, as this runs on every line.
    feast = sorted({start + timedelta(days=i) for start, end in festivals for i in range((end - start).days + 1)})
    windows = day.isin(feast) if feast else F.lit(False)
    holidays = (F.month(day) * 100 + F.dayofmonth(day)).isin([100 * m + d for m, d in config.PUBLIC_HOLIDAYS])
    return {
        "level": F.lit(1.0), "trend": F.datediff(day, F.lit(TREND_ORIGIN)) / 365.25, **weekday,
        "weekend": one(F.weekday(day) >= 5), "month_end": one(day == F.last_day(day)),
        "payday": one(F.dayofmonth(day).isin(config.PAYDAYS)), "festival_window": one(windows), "public_holiday": one(holidays),
    }


def moment_sums(amount: Column, day: Column, festivals: list[Span]) -> list[Column]:
    """Aggregates of the amount times every term but the level, which is the plain sum."""
    return [F.sum(amount * x).alias(f"y_{name}") for name, x in list(terms(day, festivals).items())[1:]]


def moment_totals(festivals: list[Span]) -> list[Column]:
    """The same added up over finer cells."""
    names = list(terms(F.current_date(), festivals))[1:]
    return [F.sum(f"y_{name}").alias(f"y_{name}") for name in names]


def with_moments(sums: DataFrame, keys: list[str | Column], net: str, festivals: list[Span], unit: float = config.CRORE) -> DataFrame:
    """Cells with their moments in term order, all in ``unit``: keys, value (rounded), y."""
    names = list(terms(F.current_date(), festivals))[1:]
    return sums.select(*keys, rounded(F.col(net) / unit).alias("value"),
                       F.array(*[F.col(c) / unit for c in (net, *[f"y_{name}" for name in names])]).alias("y"))


def calendar_moments(cells: DataFrame, festivals: list[Span]) -> DataFrame:
    """Sums of products of terms over the days of every month the cells span."""
    days = cells.agg(F.min("period").alias("lo"), F.last_day(F.max("period")).alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day"))
    x = terms(F.col("day"), festivals)
    flat = days.select(F.date_trunc("month", "day").cast("date").alias("period"), *[c.alias(n) for n, c in x.items()])
    return flat.groupBy("period").agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a in x for b in x]).alias("xx"))


def calendar_expected(cells: DataFrame, keys: list[str], key_schema: str, festivals: list[Span],
                      months: int = config.BASELINE_FIT_MONTHS, min_days: int = 7 * config.KPIS["net_revenue"]["min_history_weeks"]) -> DataFrame:
    """``cells`` (keys, period, value, y) with ``expected``, null until enough days lie behind.

    A group is one series of months, so it stays small however many facts its
    sums hold; the calendar's sums are one row a month and can be sent to every task.
    """
    span = cells.groupBy(*keys).agg(F.sequence(F.min("period"), F.max("period"), F.expr("INTERVAL 1 MONTH")).alias("months"))
    spine = span.select(*keys, F.explode("months").alias("period")).join(F.broadcast(calendar_moments(cells, festivals)), "period").join(
        cells, [*keys, "period"], "left")

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period", kind="stable").reset_index(drop=True)
        xx = np.stack(pdf["xx"].to_numpy())
        size = int(round(xx.shape[1] ** 0.5))
        xx = xx.reshape(-1, size, size)
        y = np.stack([np.zeros(size) if v is None else v for v in pdf["y"]])
        ridge = RIDGE * np.diag(np.r_[0.0, np.ones(size - 1)])
        expected = np.full(len(pdf), np.nan)
        for i in range(1, len(pdf)):
            fit = slice(max(0, i - months), i)
            normal = xx[fit].sum(axis=0)
            if normal[0, 0] >= min_days:
                expected[i] = np.linalg.solve(normal + ridge, y[fit].sum(axis=0)) @ xx[i, 0]
        pdf["expected"] = pd.Series(expected).astype(object).where(~np.isnan(expected), None)
        return pdf[[*keys, "period", "value", "expected"]]

    held = spread_by(spine.select(*keys, "period", "value", "y", "xx"), keys)
    return held.groupBy(*keys).applyInPandas(predict, f"{key_schema}, period date, value double, expected double").where("value IS NOT NULL")


def expected_sql(prefix: str, cells: str, lines: str, day: str, amount: str, key: str, festivals: list[Span], unit: float = config.CRORE) -> dict[str, str]:
    """The same in SQL, as views named by ``prefix``: moments by plain joins, systems by elimination one term after another."""
    windows = " OR ".join(f"{{d}} BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in festivals) or "false"
    holidays = ", ".join(f"({m}, {d})" for m, d in config.PUBLIC_HOLIDAYS)
    flags = [f"isodow({{d}}) = {n}" for n in range(2, 7)] + [
        "isodow({d}) >= 6", "{d} = last_day({d})", f"day({{d}}) IN ({', '.join(map(str, config.PAYDAYS))})", f"({windows})",
        f"(month({{d}}), day({{d}})) IN ({holidays})"]
    parts = ["1.0", f"CAST({{d}} - DATE '{TREND_ORIGIN}' AS DOUBLE) / 365.25", *[f"CASE WHEN {f} THEN 1.0 ELSE 0.0 END" for f in flags]]
    size = len(parts)
    x = [p.replace("{d}", day) for p in parts]
    return {
        f"{prefix}_day_v": f"""
SELECT CAST(date_trunc('month', d) AS DATE) AS period, [{', '.join(p.replace('{d}', 'd') for p in parts)}]::DOUBLE[] AS x
FROM (SELECT CAST(unnest(generate_series(min(period), last_day(max(period)), INTERVAL 1 DAY)) AS DATE) AS d FROM {cells})
""",
        f"{prefix}_xx_v": f"""
SELECT period, i, j, sum(x[i] * x[j]) AS s FROM {prefix}_day_v, range(1, {size + 1}) a(i), range(1, {size + 1}) b(j) GROUP BY 1, 2, 3
""",
        f"{prefix}_y_v": f"""
SELECT {key}, period, unnest(range(1, {size + 1})) AS i, unnest(ys) AS s FROM (
  SELECT {key}, CAST(date_trunc('month', {day}) AS DATE) AS period, [{', '.join(f'sum({amount} * ({p})) / {unit!r}' for p in x)}] AS ys FROM {lines} GROUP BY 1, 2)
""",
        f"{prefix}_fit_v": f"""
SELECT n.{key}, n.period, list(n.line || [coalesce(y.s, 0.0)] ORDER BY n.i) AS m, max(n.days) AS days FROM (
  SELECT {key}, period, i, list(s + CASE WHEN i = j AND i > 1 THEN {RIDGE} ELSE 0.0 END ORDER BY j) AS line, max(CASE WHEN i = 1 AND j = 1 THEN s END) AS days
  FROM (SELECT c.{key}, c.period, x.i, x.j, sum(x.s) AS s FROM {cells} c JOIN (SELECT {key}, min(period) AS lo FROM {cells} GROUP BY 1) f USING ({key})
    JOIN {prefix}_xx_v x ON x.period < c.period AND x.period >= c.period - INTERVAL {config.BASELINE_FIT_MONTHS} MONTH AND x.period >= f.lo GROUP BY 1, 2, 3, 4)
  GROUP BY 1, 2, 3) n
LEFT JOIN (SELECT c.{key}, c.period, y.i, sum(y.s) AS s FROM {cells} c JOIN {prefix}_y_v y ON y.{key} = c.{key} AND y.period < c.period
    AND y.period >= c.period - INTERVAL {config.BASELINE_FIT_MONTHS} MONTH GROUP BY 1, 2, 3) y
  ON y.{key} = n.{key} AND y.period = n.period AND y.i = n.i
GROUP BY 1, 2
""",
        f"{prefix}_solved_v": f"""
SELECT {key}, period, 1 AS k, m FROM {prefix}_fit_v WHERE days >= {7 * config.KPIS["net_revenue"]["min_history_weeks"]}
UNION ALL
SELECT {key}, period, k + 1, list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
  ELSE list_transform(range(1, {size + 2}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
FROM {prefix}_solved_v WHERE k <= {size}
""",
        f"{prefix}_expected_v": f"""
SELECT c.{key}, c.period, c.value, e.expected FROM {cells} c LEFT JOIN (
  SELECT s.{key}, s.period, sum(s.m[x.j][{size + 1}] * x.s) AS expected FROM {prefix}_solved_v s
  JOIN {prefix}_xx_v x ON x.period = s.period AND x.i = 1 WHERE s.k = {size + 1} GROUP BY 1, 2) e ON e.{key} = c.{key} AND e.period = c.period
""",
    }
