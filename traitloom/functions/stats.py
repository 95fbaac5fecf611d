"""Student's t for one-row results: a small numeric finish, not a data pass."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def _beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1.0 - (a + b) * x / (a + 1)), tiny)
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + step * d) or tiny)
            c = (1.0 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * out


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t, by one formula for all degrees of freedom."""
    if t is None or df is None or df < 1 or math.isnan(t):
        return math.nan
    if t == 0:
        return 1.0
    return _beta_tail(df / (df + t * t), df / 2, 0.5)


def t_quantile(confidence: float, df: float) -> float:
    """The t with two-sided p of ``1 - confidence``, by bisection."""
    if df is None or df < 1:
        return math.nan
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - confidence else (lo, mid)
        if hi - lo < 1e-10 * max(1.0, hi):
            break
    return (lo + hi) / 2


def t_test_columns(confidence: float):
    """Column functions ``p(t, df)`` and ``quantile(df)``."""
    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(x, n) for x, n in zip(t, df)], dtype="float64")

    @F.pandas_udf("double")
    def quantile(df: pd.Series) -> pd.Series:
        return pd.Series([t_quantile(confidence, n) for n in df], dtype="float64")
    return p_value, quantile
