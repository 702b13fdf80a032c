"""Tail probabilities and quantiles of the normal, t, chi-squared and F laws.

They are evaluated on result tables (one row per estimate), never on person rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _terms(size: float) -> int:
    """Most terms of a continued fraction, which needs some multiple of the root of its parameters."""
    return 10_000 + int(50 * math.sqrt(size))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, _terms(a + x)):
        an = -i * (i - a)
        b += 2
        d = 1 / max(an * d + b, tiny)
        c = max(b + an / c, tiny)
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h
    raise ArithmeticError(f"gamma tail at ({a}, {x}) did not settle")


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, _terms(a + b)):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * h / a
    raise ArithmeticError(f"beta tail at ({a}, {b}, {x}) did not settle")


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def _invert(sf, p: float) -> float:
    lo, hi = -1.0, 1.0
    while sf(lo) < 1 - p:
        lo *= 2
    while sf(hi) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sf(mid) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def norm_ppf(p: float) -> float:
    return _invert(norm_sf, p)


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda t: t_sf(t, df), p)


def _on_columns(fn):
    def apply(*series: pd.Series) -> pd.Series:
        rows = zip(*(s.to_numpy(dtype=float) for s in series))
        return pd.Series([fn(*r) if np.all(np.isfinite(r)) else None for r in rows], dtype="float64")

    return apply


def _udf(fn):
    inner = _on_columns(fn)

    def one(a: pd.Series) -> pd.Series:
        return inner(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return inner(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return inner(a, b, c)

    return {n: F.pandas_udf(g, "double") for n, g in enumerate((one, two, three), start=1)}


def normal_p(z):
    """Two-sided normal p-value of a column."""
    return _udf(lambda v: 2 * norm_sf(abs(v)))[1](z)


def t_p(t, df):
    """Two-sided t p-value of a column."""
    return _udf(lambda v, d: 2 * t_sf(abs(v), d) if d > 0 else float("nan"))[2](t, df)


def chi2_p(x, df):
    """Upper chi-squared tail of a column."""
    return _udf(lambda v, d: chi2_sf(v, d) if d > 0 else float("nan"))[2](x, df)


def f_p(x, d1, d2):
    """Upper F tail of a column."""
    return _udf(lambda v, a, b: f_sf(v, a, b))[3](x, d1, d2)


# 97.5 % point of the standard normal law
Z95 = 1.959963984540054
