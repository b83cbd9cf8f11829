"""p-values of correlations, and draws from a Dirichlet distribution; on the driver, for a few numbers at a time."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a Pearson or Spearman correlation of n pairs, by Student's t."""
    if n < 3 or abs(r) >= 1:
        return float(n < 3)
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def kendall_p(tau: float, n: int) -> float:
    """Two-sided p of Kendall's tau of n pairs, by the normal approximation."""
    if n < 2:
        return 1.0
    return math.erfc(abs(tau) / math.sqrt((4.0 * n + 10) / (9.0 * n * (n - 1))) / math.sqrt(2))


def dirichlet(k: int, alpha: list[float] | None = None, seed: int = 0) -> list[float]:
    """One draw, through gamma draws; alpha is 1 everywhere unless given."""
    x = np.random.default_rng(seed).gamma(alpha or [1.0] * k)
    return (x / x.sum()).tolist()
