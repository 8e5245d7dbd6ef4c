"""Survival functions of the chi-square and Student distributions, in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function, by its series below a + 1 and its continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out, pos = np.ones(a.shape), x > 0
    low = pos & (x < a + 1)
    scale = np.exp(np.where(pos, -x + a * np.log(np.where(pos, x, 1)), 0) - _log_gamma(a))
    term = total = np.where(low, 1 / a, 0)
    for n in range(1, 2000):
        term = term * x / (a + n)
        total = total + term
        if not (low & (np.abs(term) > np.abs(total) * 1e-16)).any():
            break
    out = np.where(low, 1 - total * scale, out)
    high = pos & ~low
    b = np.where(high, x + 1 - a, 1.0)
    c, d = np.full(a.shape, 1e300), 1 / b
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if not (high & (np.abs(d * c - 1) > 1e-15)).any():
            break
    return np.where(high, h * scale, out)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c, d = np.ones(z.shape), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
    h = d
    for m in range(1, 2000):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = np.where(inside, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(gamma_q(df.to_numpy(float) / 2, x.to_numpy(float) / 2))


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    t, n = t.to_numpy(float), df.to_numpy(float)
    return pd.Series(beta_i(n / 2, 0.5, n / (n + t * t)))


def chi2_sf(x: Column, df: Column) -> Column:
    return F.when(x.isNotNull() & (df > 0), F.pandas_udf(_chi2, "double")(F.coalesce(x.cast("double"), F.lit(0.0)), F.greatest(df.cast("double"), F.lit(1.0))))


def t_two_sided(t: Column, df: Column) -> Column:
    return F.when(t.isNotNull() & (df > 0), F.pandas_udf(_student, "double")(F.coalesce(t.cast("double"), F.lit(0.0)), F.greatest(df.cast("double"), F.lit(1.0))))
