"""Student t probabilities for the (small) tables of fitted terms.

Spark has no t distribution, so two vectorised functions evaluate the
regularised incomplete beta function on Arrow batches of term rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) if v > 0 else math.inf for v in x.ravel()]).reshape(x.shape)


def _beta_inc(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) by the modified Lentz continued fraction, x in [0, 1].

    NaN where the fraction has not converged.
    """
    with np.errstate(all="ignore"):
        a, b, x = np.broadcast_arrays(a, b, x)
        swap = x > (a + 1) / (a + b + 2)
        p = np.where(swap, b, a)
        q = np.where(swap, a, b)
        z = np.where(swap, 1 - x, x)
        front = np.exp(
            _log_gamma(p + q)
            - _log_gamma(p)
            - _log_gamma(q)
            + p * np.log(z)
            + q * np.log1p(-z)
        )
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            last = h
            for num in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(h / last - 1), initial=0.0) < 1e-15:
                break
        h = np.where(np.abs(h / last - 1) < 1e-9, h, np.nan)
        low = np.where(z <= 0, 0.0, front * h / p)
    return np.where(swap, 1 - low, low)


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    out[ok] = _beta_inc(df[ok] / 2, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    return out


def quantile(upper: float, df: np.ndarray) -> np.ndarray:
    """t with P(T <= t) = upper (upper > 0.5), by bisection on all distinct df at once."""
    df = np.asarray(df, float)
    out = np.full(df.shape, np.nan)
    ok = df > 0
    each, code = np.unique(df[ok], return_inverse=True)
    lo, hi = np.zeros(len(each)), np.ones(len(each))

    def below(t: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 - two_sided(t, n) / 2 < upper

    rising = np.arange(len(each))
    while len(rising := rising[below(hi[rising], each[rising]) & (hi[rising] < 1e300)]):
        hi[rising] *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        low = below(mid, each)
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    out[ok] = ((lo + hi) / 2)[code]
    return out


@F.pandas_udf(T.DoubleType())
def t_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(two_sided(statistic.to_numpy(), df.to_numpy())).replace(
        {np.nan: None}
    ).astype("Float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(upper: pd.Series, df: pd.Series) -> pd.Series:
    value = np.full(len(df), np.nan)
    for u in upper.unique():
        hit = (upper == u).to_numpy()
        value[hit] = quantile(float(u), df.to_numpy()[hit])
    return pd.Series(value).replace({np.nan: None}).astype("Float64")
