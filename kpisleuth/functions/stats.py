"""p-values and small numeric helpers for already aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_EPS = 1e-14
_MAX_TERMS = 500


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta, evaluated by Lentz's method."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for m in range(1, _MAX_TERMS):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            step = d * c
            total *= step
        if abs(step - 1.0) < _EPS:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_t_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def p_student_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student p; inputs are one row per finished test."""
    out = np.array([student_t_p(a, b) for a, b in zip(t, df, strict=True)], dtype=float)
    return pd.Series(out).where(~np.isnan(out), None)


@F.pandas_udf(DoubleType())
def p_chi2_1(statistic: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return statistic.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2.0)))


def welch_t(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    error = F.sqrt(v1 / n1 + v2 / n2)
    return (m1 - m2) / F.nullif(error, F.lit(0.0))


def welch_df(v1: Column, n1: Column, v2: Column, n2: Column) -> Column:
    """Satterthwaite degrees of freedom."""
    a, b = v1 / n1, v2 / n2
    return (a + b) * (a + b) / F.nullif(a * a / (n1 - 1) + b * b / (n2 - 1), F.lit(0.0))


def sigmoid(col: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col))
