"""Distribution and special functions: numpy for the driver, Column builders for the executors.

Spark SQL has no lgamma, digamma, erf or normal distribution function, so that these are spelled
out as expressions; whole-stage code generation compiles them like any other.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling series of log gamma and of digamma
_LG = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
_DG = [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132]
_SHIFT = 8


def lgamma(x) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def digamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    for k in range(_SHIFT):
        out -= 1 / (x + k)
    y = x + _SHIFT
    out += np.log(y) - 0.5 / y
    for k, c in enumerate(_DG, 1):
        out += c / y ** (2 * k)
    return out


def trigamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    for k in range(_SHIFT):
        out += 1 / (x + k) ** 2
    y = x + _SHIFT
    return out + 1 / y + 0.5 / y**2 + 1 / (6 * y**3) - 1 / (30 * y**5) + 1 / (42 * y**7)


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1 - front * _betacf(b, a, 1 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if not df > 0 or math.isnan(t):
        return math.nan
    return betainc(df / 2, 0.5, df / (df + t * t))


def t_cdf(t: float, df: float) -> float:
    tail = t_sf2(t, df) / 2
    return 1 - tail if t > 0 else tail


def t_ppf(p: float, df: float) -> float:
    if not df > 0 or not 0 < p < 1:
        return math.nan
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        lo, hi = hi, hi * 2
        if hi > 1e300:
            return math.inf
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of Fisher's F."""
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def norm_cdf(x) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, dtype=float) / math.sqrt(2))


def norm_ppf(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def norm_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


# ---- Column builders


def lgamma_col(x: Column) -> Column:
    """log gamma for x > 0: recurrence to x + 8, then Stirling's series."""
    y = x + _SHIFT
    out = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi)
    for k, c in enumerate(_LG):
        out = out + c / F.pow(y, F.lit(2 * k + 1))
    prod = x
    for k in range(1, _SHIFT):
        prod = prod * (x + k)
    return out - F.ln(prod)


def digamma_col(x: Column) -> Column:
    y = x + _SHIFT
    out = F.ln(y) - 0.5 / y
    for k, c in enumerate(_DG, 1):
        out = out + c / F.pow(y, F.lit(2 * k))
    for k in range(_SHIFT):
        out = out - 1 / (x + k)
    return out


def trigamma_col(x: Column) -> Column:
    y = x + _SHIFT
    out = 1 / y + 0.5 / (y * y) + 1 / (6 * F.pow(y, F.lit(3))) - 1 / (30 * F.pow(y, F.lit(5))) + 1 / (42 * F.pow(y, F.lit(7)))
    for k in range(_SHIFT):
        out = out + 1 / ((x + k) * (x + k))
    return out


@cache
def _erfc_polynomial() -> tuple[float, ...]:
    """P with erfc(z) = t exp(-z^2 + P(2t - 1)), t = 2 / (2 + z), for z >= 0: interpolated at
    Chebyshev nodes, highest power first."""

    def target(u: float) -> float:
        t = (u + 1) / 2
        z = 2 / t - 2
        if z < 4:
            log = math.log(math.erfc(z)) + z * z
        else:  # the continued fraction of exp(z^2) erfc(z)
            f = z
            for k in range(80, 0, -1):
                f = z + k / 2 / f
            log = -math.log(f) - 0.5 * math.log(math.pi)
        return log - math.log(t)

    cheb = np.polynomial.chebyshev.chebinterpolate(np.vectorize(target), 24)
    return tuple(np.polynomial.chebyshev.cheb2poly(cheb)[::-1])


def norm_cdf_col(z: Column) -> Column:
    """Normal distribution function, to about 1e-14."""
    a = F.abs(z) * F.lit(1 / math.sqrt(2))
    s = 4 / (2 + a) - 1
    poly = None
    for c in _erfc_polynomial():
        poly = F.lit(c) if poly is None else poly * s + F.lit(c)
    upper = F.exp(poly - a * a) / (2 + a)  # half of erfc
    return F.when(z > 0, 1 - upper).otherwise(upper)


def norm_pdf_col(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
