"""Upper tail of the F distribution for a handful of scalars on the driver.

One number per feature is evaluated, after Spark has reduced the data to one
row per class.
"""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)) without cancelling two huge numbers.

    With a million million rows both logarithms are near 1e13 and their difference would
    keep only a few digits, so large arguments use the expanded difference.
    """
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    c = a + b
    tail = (1 / c - 1 / a) / 12 - (1 / c**3 - 1 / a**3) / 360
    return (c - 0.5) * math.log1p(b / a) + b * math.log(a) - b + tail


def incomplete_beta(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta function I_x(a, b); y = 1 - x is passed for accuracy."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    large, small = max(a, b), min(a, b)
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    front = math.exp(_log_gamma_ratio(large, small) - math.lgamma(small) + a * log_x + b * log_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def f_upper_tail(f: float, df_between: float, df_within: float) -> float:
    """P(F >= f)."""
    if f <= 0.0:
        return 1.0
    if math.isinf(f):
        return 0.0
    if df_within > 1e8:
        # The chi-squared limit; its relative error is of the order 1 / df_within.
        return upper_gamma(df_between / 2.0, df_between * f / 2.0)
    total = df_within + df_between * f
    return incomplete_beta(df_within / 2.0, df_between / 2.0, df_within / total, df_between * f / total)
