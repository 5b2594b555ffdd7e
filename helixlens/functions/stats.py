"""Binomial tail probabilities, which Spark has no function for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def incomplete_beta(x: float, a: float, b: float, eps: float = 1e-15, rounds: int = 20_000) -> float:
    """Regularised incomplete beta function, by the continued fraction in Lentz's form."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a, eps, rounds)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    value = d
    for m in range(1, rounds):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or _TINY)
            c = 1 + numerator / c or _TINY
            value *= c * d
        if abs(c * d - 1) < eps:
            break
    return front * value


def binomial_cdf(n: int, p: float, x: int) -> float:
    """P(X <= x) of n trials."""
    if x < 0:
        return 0.0
    return 1.0 if x >= n else 1 - incomplete_beta(p, x + 1, n - x)


def scaled_binomial_tail(n: Column, p: Column, x: Column, scale: float) -> Column:
    """(1 - P(X <= x)) * scale in single precision: the difference is taken in double precision, cancellation included."""

    @F.pandas_udf("float")
    def tail(n: pd.Series, p: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([(1 - binomial_cdf(int(i), float(q), int(k))) * scale for i, q, k in zip(n, p, x, strict=True)], dtype=np.float32)

    return tail(n, p, x)
