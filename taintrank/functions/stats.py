"""Scalar statistics evaluated on one-row aggregate results (driver side).

Only closed forms on already-aggregated numbers live here: the Student t
distribution's two-sided p-value through the regularised incomplete beta
function (continued fraction, modified Lentz), since scipy is not available.
"""

from __future__ import annotations

import math


def _betacf(a: float, b: float, x: float, max_iter: int = 400, eps: float = 1e-15) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t with ``dof`` degrees of freedom."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def pooled_t(n1: int, m1: float, v1: float, n2: int, m2: float, v2: float) -> tuple[float, float]:
    """Pooled two-sample t statistic and p-value from group n, mean, sample var."""
    dof = n1 + n2 - 2
    if dof <= 0:
        return float("nan"), float("nan")
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
    denom = math.sqrt(sp2 * (1.0 / n1 + 1.0 / n2))
    if denom == 0:
        t = float("nan") if m1 == m2 else math.copysign(float("inf"), m1 - m2)
    else:
        t = (m1 - m2) / denom
    return t, t_two_sided_p(t, dof)
