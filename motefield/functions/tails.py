"""Tail probabilities of the t and chi-square distributions, for one-row closing steps."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Inverse of the t distribution function for p > 0.5, by bisection of the tail."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2.0 * (1.0 - p):
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_two_sided(mid, df) > 2.0 * (1.0 - p) else (low, mid)
    return (low + high) / 2.0


def chi2_upper(x: float, dims: int) -> float:
    """P(chi2_dims >= x): finite sums, from e^-h for even dims and erfc for odd ones."""
    if x <= 0.0:
        return 1.0
    half = x / 2.0
    if dims % 2 == 0:
        out, shape = math.exp(-half), 1.0
    else:
        out, shape = math.erfc(math.sqrt(half)), 0.5
    while shape < dims / 2.0:
        out += math.exp(shape * math.log(half) - half - math.lgamma(shape + 1.0))
        shape += 1.0
    return min(out, 1.0)
