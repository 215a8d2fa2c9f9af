"""Small numeric helpers for p-values: one call per comparison, never per data row."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    if math.isnan(t) or df <= 0:
        return math.nan
    tail = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p, by bisection."""
    if df <= 0:
        return math.nan
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 1.0 - t_sf(mid, df) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def signed_rank_upper(n: int, w: float) -> float:
    """P(W+ >= w) for n untied differences, by counting subsets of the ranks 1..n."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for rank in range(1, n + 1):
        ways[rank:] = ways[rank:] + ways[:-rank]
    return float(ways[max(0, math.ceil(w - 1e-9)) :].sum() / 2.0**n)


def wilcoxon_p(n: int, w_plus: float, w_minus: float, tie_term: float, clean: bool, side: str = "two-sided") -> float:
    """p-value of the signed-rank test; exact for up to 50 clean differences, else the normal form.

    ``tie_term`` is the sum of t^3 - t over tied groups, ``clean`` tells whether no tie or zero occurred.
    """
    if n == 0:
        return math.nan
    if clean and n <= 50:
        if side == "greater":
            return signed_rank_upper(n, w_plus)
        if side == "less":
            return signed_rank_upper(n, w_minus)
        return min(1.0, 2.0 * signed_rank_upper(n, max(w_plus, w_minus)))
    se = math.sqrt(max((n * (n + 1) * (2 * n + 1) - tie_term / 2.0) / 24.0, 0.0))
    if se == 0.0:
        return math.nan
    z = (w_plus - n * (n + 1) / 4.0) / se
    if side == "greater":
        return normal_sf(z)
    if side == "less":
        return normal_sf(-z)
    return 2.0 * normal_sf(abs(z))
