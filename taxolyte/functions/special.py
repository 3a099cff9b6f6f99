"""Tail probabilities in plain Python, in log space where tails are far."""

from __future__ import annotations

import math


def _log_gamma_upper(a: float, x: float) -> float:
    """ln Q(a, x), the regularized upper incomplete gamma function."""
    if x <= 0:
        return 0.0
    lead = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # series for P
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        p = math.exp(lead) * total
        return math.log1p(-p) if p < 1 else -math.inf
    # Continued fraction for Q, by Lentz's method.
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return lead + math.log(h)


def log_chi2_tail(x: float, dof: float) -> float:
    """ln P(chi-square with dof > x)."""
    return _log_gamma_upper(dof / 2, x / 2)


def chi2_tail(x: float, dof: float) -> float:
    return math.exp(log_chi2_tail(x, dof))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    lead = a * math.log(x) + b * math.log1p(-x) - math.log(a) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 100_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + an * d) or tiny)
            c = (1 + an / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(lead) * h


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def binomial_lower(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k)."""
    return 1.0 if k >= n else beta_inc(n - k, k + 1, 1 - p)


def binomial_upper(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    return 1.0 if k <= 0 else beta_inc(k, n - k + 1, p)


def log_factorials(n: int) -> list[float]:
    return [math.lgamma(i + 1) for i in range(n + 1)]
