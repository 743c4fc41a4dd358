"""Tail probabilities of the test statistics, applied to one-row (or k-row) results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_cf(a: float, b: float, x: float) -> float:
    # modified Lentz evaluation of the continued fraction of the incomplete beta
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def inc_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def inc_gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def f_tail(f: float, df1: float, df2: float) -> float:
    return inc_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f >= 0 else 1.0


def chi2_tail(h: float, df: float) -> float:
    return inc_gamma_upper(df / 2.0, h / 2.0)


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return inc_beta(df / 2.0, 0.5, df / (df + t * t))


def kolmogorov_tail(x: float) -> float:
    """Two-sided limit distribution."""
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * x * x) for j in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def ks_exact_tail(d: float, n1: int, n2: int) -> float:
    """P(D >= d) of the two-sided two-sample statistic, exactly, for samples without ties.

    All orders of the pooled values are equally likely; an order is a lattice
    path from (0, 0) to (n1, n2), and D is the largest |i/n1 - j/n2| on it. The
    chance that a path to (i, j) has met the bound follows from the two cells
    before it, in the shares i and j of their sum. Taken as chances, not counts, nothing
    overflows, and as only positive terms are added, small tails keep their digits. All cells of one
    length i + j are one array step: n1 * n2 cells, n1 + n2 steps.
    """
    bound = round(d * n1 * n2)  # D is a whole multiple of 1 / (n1 * n2)
    if bound <= 0:
        return 1.0
    m, n = min(n1, n2), max(n1, n2)
    i = np.arange(m + 1)
    met = np.zeros(m + 1)
    for length in range(1, m + n + 1):
        low, high = max(0, length - n), min(length, m)
        at = i[low : high + 1]
        up = (length - at) * met[low : high + 1]
        up[1:] += at[1:] * met[low:high]
        if low:
            up[0] += low * met[low - 1]
        up /= length
        up[np.abs(at * n - (length - at) * m) >= bound] = 1.0
        met[low : high + 1] = up
    return min(1.0, float(met[m]))


def _column(fn, *args: Column) -> Column:
    def tail(rows: pd.DataFrame) -> pd.Series:
        cells = rows.itertuples(index=False, name=None)
        return pd.Series(
            [fn(*r) if all(v == v for v in r) else None for r in cells], dtype="float64"
        )

    tail.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    fields = [a.cast("double").alias(f"c{i}") for i, a in enumerate(args)]
    return F.pandas_udf(tail, "double")(F.struct(*fields))


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    return _column(f_tail, f, df1, df2)


def chi2_p(h: Column, df: Column) -> Column:
    return _column(chi2_tail, h, df)


def t_p(t: Column, df: Column) -> Column:
    return _column(t_tail, t, df)


def r_p(r: Column, df: Column) -> Column:
    """Two-sided p of a correlation with ``df`` degrees of freedom."""

    def tail(rv: float, dv: float) -> float:
        if dv <= 0:
            return float("nan")
        if abs(rv) >= 1.0:
            return 0.0
        return t_tail(rv * math.sqrt(dv / (1.0 - rv * rv)), dv)

    return _column(tail, r, df)


def ks_p(d: Column, n1: Column, n2: Column, exact_up_to: int = 0) -> Column:
    """Two-sided p: exact while the larger sample has at most ``exact_up_to`` values, the limit law beyond."""

    def tail(dv: float, a: float, b: float) -> float:
        if max(a, b) <= exact_up_to:
            return ks_exact_tail(dv, int(a), int(b))
        return kolmogorov_tail(dv * math.sqrt(a * b / (a + b)))

    return _column(tail, d, n1, n2)
