"""Tail probabilities of normal, t, F, chi-squared, Kolmogorov-Smirnov and studentised-range statistics, in plain Python for few values."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or tiny)
        c = b + n / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return _gamma_q(dof / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction on the side where it converges fast."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(2000):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_sf2(t: float, dof: float) -> float:
    """Two-sided."""
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def ks_sf(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sided p of a two-sample statistic."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


@lru_cache(4096)
def tukey_sf(q: float, k: int, dof: float) -> float:
    """Studentised range: the range of k normals over an independent deviation, integrated on grids."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    grid = np.linspace(-9, 9 + 16, 6001)
    cdf = 0.5 * (1 + np.vectorize(math.erf)(grid / math.sqrt(2)))

    def ranges(w: np.ndarray) -> np.ndarray:
        high = np.interp(z[None, :] + w[:, None], grid, cdf, right=1.0)
        low = np.interp(z, grid, cdf)[None, :]
        return np.trapezoid(k * pdf[None, :] * np.maximum(high - low, 0) ** (k - 1), z, axis=1)

    if dof > 5000:
        return float(max(0.0, 1 - ranges(np.array([q]))[0]))
    # deviation s with dof * s^2 chi-squared
    s = np.linspace(1e-4, 1 + 10 / math.sqrt(dof), 1200)
    log = (dof / 2) * math.log(dof / 2) - math.lgamma(dof / 2) + math.log(2) + (dof - 1) * np.log(s) - dof * s * s / 2
    return float(min(1.0, max(0.0, 1 - np.trapezoid(ranges(q * s) * np.exp(log), s))))
