"""Student t and Wilcoxon signed-rank probabilities for summary rows, for any number of folds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_RANKS = 50  # up to here, without ties, the signed-rank distribution is counted out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz's evaluation)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def t_p_value(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of a t statistic; None when the statistic is unknown."""
    if t is None or df is None or math.isnan(t) or df < 1:
        return None
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(confidence: float, df: float | None) -> float | None:
    """Value that a t variable stays within, in size, with the given probability."""
    if df is None or df < 1:
        return None
    low, high = 0.0, 1.0
    while t_p_value(high, df) > 1 - confidence:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if t_p_value(middle, df) > 1 - confidence else (low, middle)
    return (low + high) / 2


def signed_rank_p_value(w: float | None, n: int | None, ties: float) -> float | None:
    """Two-sided p-value of the smaller rank sum over ``n`` non-zero differences.

    ``ties`` is the sum of t^3 - t over groups of t equal sizes. Small samples without ties are counted
    out; else the normal approximation with tie correction is taken.
    """
    if w is None or not n:
        return None
    if n <= EXACT_RANKS and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for s in range(len(ways) - 1, rank - 1, -1):
                ways[s] += ways[s - rank]
        return min(1.0, 2 * sum(ways[:int(w) + 1]) / 2 ** n)
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if variance <= 0:
        return None
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(variance) / math.sqrt(2))


def _plain(value):
    return None if value is None or pd.isna(value) else value


@F.pandas_udf(T.DoubleType())
def t_quantile_of(confidence: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(c, _plain(d)) for c, d in zip(confidence, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value_of(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(_plain(a), _plain(d)) for a, d in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def signed_rank_p_value_of(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p_value(_plain(a), _plain(m) and int(m), float(_plain(t) or 0)) for a, m, t in zip(w, n, ties)],
                     dtype="float64")
