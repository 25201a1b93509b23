"""Tail probabilities of aggregated test statistics.

Each call works on the few rows left after aggregation (one per comparison), as Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(front) * h / a


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def sign_two_sided(wins: int, losses: int) -> float:
    """Two-sided binomial test with p = 1/2: twice the smaller tail, at most 1."""
    n, k = wins + losses, min(wins, losses)
    if 2 * k == n:
        return 1.0
    return min(1.0, 2.0 * incomplete_beta(n - k, k + 1.0, 0.5))


def signed_rank_exact(statistic: float, n: int) -> float:
    """Two-sided p of the smaller rank sum from its exact null distribution (no ties, no zeros)."""
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for s, w in enumerate(ways):
            longer[s + rank] += w
        ways = longer
    return min(1.0, 2.0 * sum(ways[: int(statistic) + 1]) / 2.0 ** n)


def signed_rank_two_sided(statistic: float, n: int, tie_term: float, zeros: int) -> float:
    """Normal approximation with the tie term; zero differences are left out before."""
    if n == 0:
        return math.nan
    spread = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2.0) / 24.0)
    return normal_two_sided((statistic - n * (n + 1) / 4.0) / spread) if spread > 0 else math.nan


def _row_wise(function):
    """Lift a scalar function to Arrow batches, missing when an argument is missing."""
    def batch(*args: pd.Series) -> pd.Series:
        def one(*values):
            if any(pd.isna(v) for v in values):
                return None
            out = function(*values)
            return None if out != out else out
        return pd.Series([one(*v) for v in zip(*args)], dtype="object")
    return batch


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _row_wise(normal_two_sided)(z)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _row_wise(student_two_sided)(t, df)


@F.pandas_udf(DoubleType())
def sign_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    def one(w, l):
        return sign_two_sided(int(w), int(l)) if w + l > 0 else math.nan
    return _row_wise(one)(wins, losses)


@F.pandas_udf(DoubleType())
def signed_rank_p(statistic: pd.Series, n: pd.Series, tie_term: pd.Series, zeros: pd.Series) -> pd.Series:
    return _row_wise(lambda s, k, t, z: signed_rank_two_sided(s, int(k), t, int(z)))(statistic, n, tie_term, zeros)


@F.pandas_udf(DoubleType())
def signed_rank_exact_p(statistic: pd.Series, n: pd.Series, tie_term: pd.Series, zeros: pd.Series) -> pd.Series:
    """Missing where differences are tied or zero, which have no exact distribution here."""
    def one(s, k, t, z):
        return signed_rank_exact(s, int(k)) if k > 0 and t == 0 and z == 0 else math.nan
    return _row_wise(one)(statistic, n, tie_term, zeros)
