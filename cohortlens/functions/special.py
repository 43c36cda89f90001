"""Survival functions that Spark SQL lacks.

Distribution tails are needed on result tables with a row for each feature or pair, so the general forms are
Arrow-batched; where a closed form exists there is a column expression as well.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_sf_even(x: Column, df: int) -> Column:
    """P(X >= x) of a chi-squared variable with an even number of degrees of freedom, in closed form."""
    if df < 2 or df % 2:
        raise ValueError("df must be even")
    terms = [F.pow(x / 2, F.lit(j)) / F.lit(float(math.factorial(j))) for j in range(df // 2)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.exp(-x / 2) * total


def _gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if not (x >= 0) or a <= 0:
        return float("nan")
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b or tiny
        c = b + an / c or tiny
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or tiny)
            c = 1 + n / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return _beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if math.isinf(t) and df > 0 else float("nan"))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _columnwise(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([fn(*map(float, row)) if all(v is not None and not pd.isna(v) for v in row) else None for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x) of a chi-squared variable."""
    return _columnwise(chi2_tail, x, df)


@F.pandas_udf(DoubleType())
def t_sf2(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return _columnwise(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def normal_sf2(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal variable."""
    return _columnwise(normal_two_sided, z)


def mannwhitney_exact(u: float, n: int, m: int) -> float:
    """Two-sided exact p of U without ties: partitions counted by dynamic programming."""
    counts = np.zeros(n * m + 1)
    counts[0] = 1
    for k in range(1, n + 1):  # multiply by (1 - q^(m + k)) / (1 - q^k)
        for i in range(n * m, m + k - 1, -1):
            counts[i] -= counts[i - m - k]
        for i in range(k, n * m + 1):
            counts[i] += counts[i - k]
    high = max(u, n * m - u)
    return float(min(1.0, 2 * counts[int(math.ceil(high)) :].sum() / counts.sum()))


@F.pandas_udf(DoubleType())
def mannwhitney_p(u: pd.Series, n: pd.Series, m: pd.Series, tie: pd.Series) -> pd.Series:
    """Two-sided p of U: exact if the smaller sample has at most 8 values and there are no ties, else normal.

    tie is the sum of t**3 - t over tied groups. The normal form corrects for ties and continuity.
    """

    def one(u: float, n: float, m: float, tie: float) -> float:
        if min(n, m) <= 8 and tie == 0:
            return mannwhitney_exact(u, int(n), int(m))
        total = n + m
        var = n * m / 12 * ((total + 1) - tie / (total * (total - 1)))
        if var <= 0:
            return 1.0
        return min(1.0, normal_two_sided((max(u, n * m - u) - n * m / 2 - 0.5) / math.sqrt(var)) if max(u, n * m - u) - n * m / 2 > 0.5 else 1.0)

    return _columnwise(one, u, n, m, tie)
