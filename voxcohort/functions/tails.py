"""Tail probabilities as Arrow functions, for the small tables of test statistics."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _gamma_log(x: float) -> float:
    import math

    return math.lgamma(x)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    import math

    if not (a > 0 and x >= 0):
        return math.nan
    if x == 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - _gamma_log(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    import math

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(_gamma_log(a + b) - _gamma_log(a) - _gamma_log(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return float("nan") if not df > 0 else beta_lower(df / 2, 0.5, df / (df + t * t)) if np.isfinite(t) else 0.0


@lru_cache(maxsize=256)
def _rank_sum_counts(m: int, n: int) -> tuple[int, ...]:
    """How many of the orders of m and n values have U = 0, 1, ..., m n."""
    ways = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            ways[u] -= ways[u - n - i]
        for u in range(i, m * n + 1):
            ways[u] += ways[u - i]
    return tuple(ways)


def mwu_exact(u: float, m: int, n: int) -> float:
    """Two-sided exact p of a Mann-Whitney U without ties."""
    ways = _rank_sum_counts(min(m, n), max(m, n))
    high = int(np.ceil(max(u, m * n - u)))
    return min(1.0, 2 * sum(ways[high:]) / sum(ways))


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in v) else f(*v) for v in zip(*columns, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, k: gamma_upper(k / 2, a / 2), x, df)


@pandas_udf(DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided."""
    return _each(t_two_sided, t, df)


@pandas_udf(DoubleType())
def norm_sf2(z: pd.Series) -> pd.Series:
    """Two-sided."""
    import math

    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


@pandas_udf(DoubleType())
def mwu_exact_sf(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda a, b, c: mwu_exact(a, int(b), int(c)), u, m, n)
