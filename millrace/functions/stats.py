"""Tail probabilities, from the regularised incomplete beta and gamma functions."""

from __future__ import annotations

import math


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: a series, or a continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - scale * h)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return 1 - _gamma_p(k / 2, x / 2) if k > 0 else 1.0


def f_sf(f: float, d1: float, d2: float) -> float:
    return 0.0 if math.isinf(f) else _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided."""
    return _beta(df / 2, 0.5, df / (df + t * t))


def ks_sf(d: float, n: int, m: int) -> float:
    """Two-sample Kolmogorov-Smirnov, asymptotic."""
    en = math.sqrt(n * m / (n + m)) if n and m else 0.0
    x = (en + 0.12 + 0.11 / en) * d if en else 0.0
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def welch(m1: float, v1: float, n1: int, m2: float, v2: float, n2: int) -> tuple[float, float]:
    """t and its two-sided probability."""
    a, b = v1 / n1, v2 / n2
    if a + b == 0:
        return 0.0, 1.0
    t = (m1 - m2) / math.sqrt(a + b)
    return t, t_sf2(t, (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)))
