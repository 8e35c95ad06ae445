"""Distribution functions that Spark lacks, in numpy, as Arrow-batched pandas UDFs over statistics that are already aggregated."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()
_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = 1e-300
        c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, rounds):
            for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + t * d
                c = 1 + t / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def gamma_q(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function."""
    s, x = np.broadcast_arrays(np.asarray(s, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        front = np.exp(s * np.log(x) - x - _lgamma(s))
        term = total = 1 / s
        for n in range(1, 2000):
            term = term * x / (s + n)
            total = total + term
            if np.nanmax(np.abs(term / total), initial=0) < 1e-16:
                break
        low = front * total
        b = x + 1 - s
        c, d = np.full_like(x, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
                break
        return np.where(x <= 0, 1.0, np.where(x < s + 1, 1 - low, front * h))


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def student_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """The value that a Student variable stays below with probability p > 0.5, by bisection."""
    df = np.asarray(df, float)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e6)
    for _ in range(200):
        mid = (lo + hi) / 2
        low = 1 - student_two_sided(mid, df) / 2 < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def fisher_two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact test of 2 x 2 tables: the probability of all tables with these margins that are no likelier."""
    out = np.empty(len(a))
    for n, (w, x, y, z) in enumerate(zip(a, b, c, d, strict=True)):
        row, col, other = w + x, w + y, y + z
        i = np.arange(max(0.0, col - other), min(row, col) + 1)
        p = -(_lgamma(i + 1) + _lgamma(row - i + 1) + _lgamma(col - i + 1) + _lgamma(other - col + i + 1))
        p = np.exp(p - p.max())
        own = p[int(w - i[0])]
        out[n] = min(1.0, p[p <= own * (1 + 1e-7)].sum() / p.sum())
    return out


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p of 3 to 5,000 sorted values, by the weights and the normalising curves of Royston (1995); NaN for other sizes and for equal values."""
    n = len(x)
    if not 3 <= n <= 5000 or x[-1] - x[0] <= 1e-19:
        return math.nan, math.nan
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, c = 1 / math.sqrt(n), m / math.sqrt((m * m).sum())
    w = c.copy()
    if n == 3:
        w[:] = (-math.sqrt(0.5), 0.0, math.sqrt(0.5))
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n > 5:
            before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            rest = ((m * m).sum() - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            w[2:-2] = m[2:-2] / math.sqrt(rest)
            w[-2], w[1] = before, -before
        else:
            w[1:-1] = m[1:-1] / math.sqrt(((m * m).sum() - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        w[-1], w[0] = last, -last
    stat = min(float((w @ x) ** 2 / ((x - x.mean()) ** 2).sum()), 1.0)
    if n == 3:
        return stat, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(stat)) - math.asin(math.sqrt(0.75)))))
    if stat >= 1:
        return stat, 1.0
    if n <= 11:
        y = -math.log(max(-2.273 + 0.459 * n - math.log(1 - stat), 1e-300))
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, v = math.log(1 - stat), math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
    return stat, float(normal_sf((y - mean) / sd))


def dunnett_two_sided(t: float, shares: np.ndarray, df: float) -> float:
    """P(max |T| > t) of treatments against one control, T a multivariate Student variable. shares: of each treatment n / (n + n of the control); correlations are products of their roots, so that the probability is an integral over the
    control's mean and the common deviation only."""
    z, wz = np.polynomial.hermite_e.hermegauss(80)
    wz = wz / wz.sum()
    x, wx = np.polynomial.legendre.leggauss(80)
    half = 8 / math.sqrt(2 * df)
    lo, hi = max(1e-9, 1 - half), 1 + half + 2 / df
    s, ws = lo + (x + 1) / 2 * (hi - lo), wx * (hi - lo) / 2
    density = ws * np.exp(math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2)
    below = lambda v: 1 - normal_sf(v)
    inside = np.ones((len(z), len(s)))
    for share in shares:
        a, b = math.sqrt(share), math.sqrt(1 - share)
        inside *= below((a * z[:, None] + abs(t) * s) / b) - below((a * z[:, None] - abs(t) * s) / b)
    return float(min(1.0, max(0.0, 1 - wz @ inside @ density)))


def _udf(f, n: int):
    """A double column function of n columns; a row with a null gives a null."""

    def run(*xs: pd.Series) -> pd.Series:
        ok = np.logical_and.reduce([x.notna().to_numpy() for x in xs])
        out = np.full(len(xs[0]), np.nan)
        if ok.any():
            out[ok] = f(*(x.to_numpy(float)[ok] for x in xs))
        return pd.Series(out).where(ok)

    wrappers = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c), 4: lambda a, b, c, d: run(a, b, c, d)}
    g = wrappers[n]
    g.__annotations__ = {k: pd.Series for k in "abcd"[:n]} | {"return": pd.Series}
    return F.pandas_udf(g, "double")


def p_student(t: Column, df: Column) -> Column:
    return _udf(student_two_sided, 2)(t, df)


def p_normal_two_sided(z: Column) -> Column:
    return _udf(lambda v: 2 * normal_sf(np.abs(v)), 1)(z)


def p_chi2(x: Column, df: Column) -> Column:
    return _udf(chi2_upper, 2)(x, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _udf(f_upper, 3)(f, d1, d2)


def t_quantile(p: float, df: Column) -> Column:
    return _udf(lambda v: student_quantile(p, v), 1)(df)


def p_fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the cells of a 2 x 2 table by rows."""
    return _udf(fisher_two_sided, 4)(a, b, c, d)
