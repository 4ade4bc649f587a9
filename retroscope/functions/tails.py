"""Tail probabilities for test statistics.

Spark SQL has none. They are applied to result rows only (one per test), as Arrow
batches, or to a plain number.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _upper_gamma_ratio(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: power series left of a+1, continued fraction right."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        delta = c * d
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return h * front


def chi2_tail(x: float, dof: float) -> float:
    """P(X > x) of a chi-square with ``dof`` degrees of freedom."""
    return _upper_gamma_ratio(dof / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|) through the incomplete beta function's continued fraction."""
    x = dof / (dof + t * t)
    return _beta_ratio(dof / 2.0, 0.5, x)


def _beta_ratio(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_ratio(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d or tiny)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 / (1.0 + coef * d or tiny)
            c = 1.0 + coef / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * front


def fisher_two_sided(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """Odds ratio and two-sided exact p: all tables no likelier than the one seen."""
    r1, r2, c1 = a + b, c + d, a + c
    low, high = max(0, c1 - r2), min(r1, c1)

    def log_p(k: int) -> float:
        return (
            math.lgamma(r1 + 1) - math.lgamma(k + 1) - math.lgamma(r1 - k + 1)
            + math.lgamma(r2 + 1) - math.lgamma(c1 - k + 1) - math.lgamma(r2 - c1 + k + 1)
            - math.lgamma(r1 + r2 + 1) + math.lgamma(c1 + 1) + math.lgamma(r1 + r2 - c1 + 1)
        )

    def tail(start: int, step: int) -> float:
        """Sum away from the mode until the terms no longer count."""
        total, k = 0.0, start
        while low <= k <= high:
            term = math.exp(log_p(k))
            total += term
            if term < total * 1e-17:
                break
            k += step
        return total

    def first_unlikely(inner: int, outer: int, step: int) -> int:
        """Nearest k to the mode, on the side of ``outer``, no likelier than the one seen."""
        if log_p(outer) > limit:
            return outer + step
        while inner != outer:
            mid = (inner + outer) // 2 if step > 0 else -((-inner - outer) // 2)
            if log_p(mid) <= limit:
                outer = mid
            else:
                inner = mid + step
        return outer

    limit = log_p(a) + 1e-7
    mode = min(high, max(low, (r1 + 1) * (c1 + 1) // (r1 + r2 + 2)))
    if log_p(mode) <= limit:
        p = 1.0
    else:
        p = tail(first_unlikely(mode, high, 1), 1) + tail(first_unlikely(mode, low, -1), -1)
    odds = float("nan") if 0 in (b * c, a * d) and a * d == b * c else (
        float("inf") if b * c == 0 else a * d / (b * c)
    )
    return odds, min(p, 1.0)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(v) or pd.isna(k) or k < 1 else chi2_tail(v, k) for v, k in zip(x, dof)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(v) or pd.isna(k) or k < 1 else t_two_sided(v, k) for v, k in zip(t, dof)
    ], dtype="float64")


@F.pandas_udf(
    T.StructType([
        T.StructField("odds_ratio", T.DoubleType()), T.StructField("p_value", T.DoubleType())
    ])
)
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    rows = [fisher_two_sided(int(p), int(q), int(r), int(s)) for p, q, r, s in zip(a, b, c, d)]
    return pd.DataFrame(rows, columns=["odds_ratio", "p_value"])


def chi2_p(x: Column, dof: Column) -> Column:
    return _chi2_tail(x.cast("double"), dof.cast("double"))


def normal_p(z: Column) -> Column:
    return _normal_two_sided(z.cast("double"))


def t_p(t: Column, dof: Column) -> Column:
    return _t_two_sided(t.cast("double"), dof.cast("double"))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _fisher(*[x.cast("bigint") for x in (a, b, c, d)])
