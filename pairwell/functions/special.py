"""Tail probabilities with NumPy, used on the few rows of a finished test result."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: recurrence up to 10, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    z = 1.0 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_fraction(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return math.nan
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def chi_square_tail(x: float, dof: float) -> float:
    if not (math.isfinite(x) and dof > 0):
        return math.nan
    return gamma_upper(dof / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else math.nan


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of all hypergeometric terms that are not larger than the observed one."""
    row, column, total = a + b, a + c, a + b + c + d
    low, high = max(0, column - (total - row)), min(row, column)
    if low == high:
        return 1.0
    mean = row * column / total
    sd = math.sqrt(max(mean * (1 - column / total) * (total - row) / max(total - 1, 1), 1.0))
    # Terms further than 60 sd out are far below the smallest double.
    start, stop = max(low, int(mean - 60 * sd)), min(high, int(mean + 60 * sd) + 1)
    start, stop = min(start, a), max(stop, a)
    k = np.arange(start, stop + 1, dtype=float)
    lg = log_gamma
    terms = -(lg(k + 1) + lg(row - k + 1) + lg(column - k + 1) + lg(total - row - column + k + 1))
    terms -= terms.max()
    mass = np.exp(terms)
    observed = mass[a - start]
    return float(min(1.0, mass[mass <= observed * (1 + 1e-7)].sum() / mass.sum()))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else math.nan for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(a, b) if pd.notna(a) and pd.notna(b) else math.nan for a, b in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) if pd.notna(a) else math.nan for a in z])


@F.pandas_udf(T.DoubleType())
def fisher_p_value(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])
