"""Tail probabilities of the t, F and chi-square distributions.

Only numbers left after an aggregation pass through here: single ones on the driver, one
row a test in Arrow batches on the executors.
The incomplete beta and gamma functions use the continued fractions and series of
the standard numerical literature.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

_TINY = 1e-300
_PRECISION = 1e-15
_STEPS = 10_000


def _continued_fraction(term, start: float) -> float:
    """Evaluate start + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method."""
    value = start or _TINY
    c, d = value, 0.0
    for step in range(1, _STEPS):
        a, b = term(step)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _PRECISION:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)

    def term(step: int) -> tuple[float, float]:
        if step == 1:
            return 1.0, 1.0
        m, odd = divmod(step - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(scale) * _continued_fraction(term, 0.0) / a


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        total = term = 1.0 / a
        for step in range(1, _STEPS):
            term *= x / (a + step)
            total += term
            if term < total * _PRECISION:
                break
        return 1.0 - scale * total

    def fraction(step: int) -> tuple[float, float]:
        if step == 1:
            return 1.0, x + 1.0 - a
        k = step - 1
        return -k * (k - a), x + 2 * k + 1.0 - a

    return scale * _continued_fraction(fraction, 0.0)


def t_two_sided(statistic: float, dof: float) -> float:
    """P(|T| >= |statistic|)."""
    if math.isinf(statistic):
        return 0.0
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + statistic * statistic))


def f_upper(statistic: float, dof1: float, dof2: float) -> float:
    if math.isinf(statistic):
        return 0.0
    return incomplete_beta(dof2 / 2.0, dof1 / 2.0, dof2 / (dof2 + dof1 * statistic))


def chi_square_upper(statistic: float, dof: float) -> float:
    return upper_gamma(dof / 2.0, statistic / 2.0)


def r_two_sided(r: float, dof: float) -> float:
    """P(|R| >= |r|) of a correlation over dof + 2 pairs of independent values."""
    rest = 1 - min(1.0, r * r)
    return 0.0 if rest == 0 else t_two_sided(r * math.sqrt(dof / rest), dof)


TAILS: dict[str, Callable[[float, float, float], float]] = {
    "t": lambda statistic, dof, _: t_two_sided(statistic, dof),
    "F": f_upper,
    "chi-square": lambda statistic, dof, _: chi_square_upper(statistic, dof),
    "r": lambda statistic, dof, _: r_two_sided(statistic, dof),
}


def p_value(tail: str, statistic: Column, dof: Column, second_dof: Column) -> Column:
    """The p-value of each row's statistic; missing where the statistic is NULL or NaN."""
    probability, two = TAILS[tail], tail == "F"

    @F.pandas_udf("double")
    def pvalues(statistics: pd.Series, dofs: pd.Series, seconds: pd.Series) -> pd.Series:
        return pd.Series([
            None if pd.isna(s) or pd.isna(d) or (two and pd.isna(e)) else probability(float(s), float(d), float(e))
            for s, d, e in zip(statistics, dofs, seconds)
        ], dtype="float64")

    told = pvalues(statistic.cast("double"), dof.cast("double"), second_dof.cast("double"))
    return F.nanvl(told, F.lit(None))


def t_quantile(probability: float, dof: float) -> float:
    """The value below which a t variable falls with the given probability."""
    if not 0.0 < probability < 1.0:
        raise ValueError("A probability between 0 and 1 is required.")
    if probability < 0.5:
        return -t_quantile(1.0 - probability, dof)
    tail = 2.0 * (1.0 - probability)
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, dof) > tail:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0
