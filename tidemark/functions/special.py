"""Distribution functions in plain numpy: normal, Student t, beta."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _NORMAL.inv_cdf(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return front * h / a


def beta_ppf(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if beta_cdf(mid, a, b) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2.0, 0.5)
    return tail if t >= 0 else 1.0 - tail


def t_cdf(t: float, df: float) -> float:
    return 1.0 - t_sf(t, df)


@lru_cache(maxsize=100_000)
def t_isf(tail: float, df: float) -> float:
    """The t beyond which ``tail`` of the mass lies: Cornish-Fisher for many degrees of freedom, bisection else."""
    if tail >= 0.5:
        return -t_isf(1.0 - tail, df) if tail > 0.5 else 0.0
    z = -normal_ppf(tail)
    if df > 60:
        return (
            z
            + (z**3 + z) / (4 * df)
            + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
            + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df**3)
        )
    lo, hi = 0.0, 1e3
    while t_sf(hi, df) > tail and hi < 1e15:
        hi *= 10
    for _ in range(120):
        mid = (lo + hi) / 2.0
        if t_sf(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def esd_limit(n: int, alpha: float) -> float:
    """Critical value of the extreme studentised deviate among ``n`` readings (Rosner 1983)."""
    if n < 3:
        return math.inf
    t = t_isf(alpha / (2.0 * n), float(n - 2))
    return (n - 1) * t / math.sqrt((n - 2 + t * t) * n)


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    return np.array([normal_cdf(float(v)) for v in np.ravel(x)]).reshape(np.shape(x))
