"""Tail probabilities of test statistics, as column expressions.

Spark has no gamma or Kolmogorov distribution. Both tails are sums or fractions of few terms, folded
over a sequence. They are needed once per monitored feature, over a handful of result rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KS_METHODS = ("limit", "exact")
_SHIFT = 15


def _log_gamma(a: Column) -> Column:
    """Stirling's series at a + _SHIFT, and the recurrence back to a."""
    y = a + float(_SHIFT)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    whole = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    steps = F.sequence(F.lit(0), F.lit(_SHIFT - 1))
    return whole - F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.log(a + i))


def chi_square_p(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic), the regularised upper incomplete gamma function Q(dof/2, statistic/2): the
    power series of its complement below the mean, Legendre's continued fraction above. Null where
    an argument is null or there is no degree of freedom."""
    a = F.when(dof > 0, dof / 2.0)
    z = F.when(statistic > 0, statistic / 2.0)
    terms = F.ceil(F.sqrt(a) * 10 + 100).cast("int")
    front = F.exp(a * F.log(z) - z - _log_gamma(a))
    # 1/a (1 + z/(a+1) (1 + z/(a+2) (1 + ...))), from the inside
    series = F.aggregate(F.sequence(terms, F.lit(1)), F.lit(1.0), lambda h, k: 1 + z / (a + k) * h) / a
    # z+1-a - 1(1-a) / (z+3-a - 2(2-a) / (z+5-a - ...)), from the inside
    fraction = F.aggregate(
        F.sequence(terms, F.lit(1)),
        z + 2 * terms + 1 - a,
        lambda f, k: z + 2 * k - 1 - a - k * (k - a) / f,
    )
    tail = F.when(z < a + 1, F.greatest(F.lit(0.0), 1 - front * series)).otherwise(front / fraction)
    return F.when((statistic <= 0) & (dof > 0), F.lit(1.0)).otherwise(tail)


def ks_limit_p(statistic: Column, n_reference: Column, n_current: Column) -> Column:
    """Kolmogorov's limit with Stephens' small-sample correction; 1 where a side has fewer than two
    values."""
    n, m = n_reference.cast("double"), n_current.cast("double")
    size = F.sqrt(F.when((n >= 2) & (m >= 2), n * m / (n + m)))
    reach = (size + 0.12 + 0.11 / size) * statistic
    terms = F.sequence(F.lit(1), F.lit(100))
    series = F.aggregate(
        terms,
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * reach * reach),
    )
    # the series converges slowly towards 1 at 0
    tail = F.when(reach < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return F.when((n < 2) | (m < 2), F.lit(1.0)).otherwise(tail)


def ks_exact_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) for two samples of n and m.

    Merging the samples in value order is a random walk that draws from either one without
    replacement. The walk's probability is carried along step by step; whatever reaches a point
    where the two empirical distributions differ by d or more is the tail.
    """
    n, m = min(n, m), max(n, m)
    reach = round(d * n * m)
    if n < 2 or reach <= 0:
        return 1.0
    size = n + m
    drawn = np.arange(n + 1, dtype=np.float64)
    walk = np.zeros(n + 2)
    walk[0] = 1.0
    low = high = 0
    tail = 0.0
    for t in range(size):
        here = walk[low : high + 1]
        from_first = here * ((n - drawn[low : high + 1]) / (size - t))
        rest = here - from_first
        moved = np.zeros(high - low + 2)
        moved[:-1] = rest
        moved[1:] += from_first
        # Points with |i*size - (t+1)*n| < reach stay inside.
        first = max(low, ((t + 1) * n - reach) // size + 1)
        last = min(high + 1, n, ((t + 1) * n + reach - 1) // size)
        if first > last:
            return 1.0
        kept = moved[first - low : last - low + 1]
        tail += float(moved[: first - low].sum() + moved[last - low + 1 :].sum())
        walk[first : last + 1] = kept
        low, high = first, last
    return min(1.0, tail)


def ks_p(statistic: Column, n_reference: Column, n_current: Column, method: str = "limit") -> Column:
    """`limit` is the default at every size. `exact` is for small windows: its work grows with
    the square of their rows, and it runs in Python workers, which must have this package."""
    if method not in KS_METHODS:
        raise ValueError(f"method must be one of {KS_METHODS}")
    if method == "limit":
        return ks_limit_p(statistic, n_reference, n_current)

    @F.pandas_udf("double")
    def run(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([ks_exact_tail(a, int(b), int(c)) for a, b, c in zip(d, n, m)], dtype="float64")

    return run(statistic, n_reference, n_current)
