"""Tails of test distributions, in plain Python: used on one row per test."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail by the regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def welch(m1: float, s1: float, n1: int, m2: float, s2: float, n2: int) -> tuple[float, float, float]:
    """t, degrees of freedom and two-sided p from means, standard deviations and sizes."""
    v1, v2 = s1 * s1 / n1, s2 * s2 / n2
    if v1 + v2 == 0:
        return 0.0, float(n1 + n2 - 2), 1.0 if m1 == m2 else 0.0
    t = (m1 - m2) / math.sqrt(v1 + v2)
    df = (v1 + v2) ** 2 / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))
    return t, df, t_two_sided(t, df)


def mcnemar(b: int, c: int) -> tuple[float, float]:
    """Chi-square with continuity correction and its p, from the discordant counts."""
    if b + c == 0:
        return 0.0, 1.0
    x = (abs(b - c) - 1) ** 2 / (b + c)
    return x, chi2_sf(x, 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables at most as likely as the one seen."""
    row, col, n = a + b, a + c, a + b + c + d

    def log_p(k: int) -> float:
        return math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1) + math.lgamma(n - row + 1) - math.lgamma(col - k + 1) - math.lgamma(n - row - col + k + 1) - math.lgamma(n + 1) + math.lgamma(col + 1) + math.lgamma(n - col + 1)

    seen = log_p(a)
    return min(1.0, sum(math.exp(p) for k in range(max(0, row + col - n), min(row, col) + 1) if (p := log_p(k)) <= seen + 1e-7))


def student(m1: float, ss1: float, n1: int, m2: float, ss2: float, n2: int) -> tuple[float, float]:
    """t and two-sided p with a common variance, from means, sums of squared deviations and sizes."""
    df = n1 + n2 - 2
    pooled = (ss1 + ss2) / df
    if pooled == 0:
        return (0.0, 1.0) if m1 == m2 else (math.copysign(math.inf, m1 - m2), 0.0)
    t = (m1 - m2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    return t, t_two_sided(t, df)


def paired(difference: float, variance: float, n: int) -> tuple[float, float]:
    """t and two-sided p of paired differences, from their mean, variance and number."""
    if variance == 0:
        return (0.0, 1.0) if difference == 0 else (math.copysign(math.inf, difference), 0.0)
    t = difference / math.sqrt(variance / n)
    return t, t_two_sided(t, n - 1)
