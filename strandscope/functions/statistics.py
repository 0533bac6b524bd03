"""Small numeric helpers used inside tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if incomplete_beta(a, b, mid) < p:
            low = mid
        else:
            high = mid
        if high - low < 1e-15:
            break
    return (low + high) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial confidence interval of k successes out of n; NaN for n = 0."""
    if n <= 0:
        return math.nan, math.nan
    tail = (1.0 - level) / 2
    low = 0.0 if k <= 0 else beta_quantile(tail, k, n - k + 1)
    high = 1.0 if k >= n else beta_quantile(1 - tail, k + 1, n - k)
    return low, high


def exact_interval_column(k, n, level: float = 0.95):
    """`struct<lo, hi>` of the exact binomial interval, Arrow batch by Arrow batch."""

    @F.pandas_udf("lo double, hi double")
    def interval(successes: pd.Series, trials: pd.Series) -> pd.DataFrame:
        pairs = [exact_interval(int(a), int(b), level) for a, b in zip(successes.fillna(0), trials.fillna(0))]
        return pd.DataFrame(pairs, columns=["lo", "hi"])

    return interval(k, n)
