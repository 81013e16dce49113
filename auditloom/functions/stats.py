"""Exact tests, intervals and rank statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mcnemar_p(b: int | None, c: int | None) -> float | None:
    """Two-sided exact p-value of ``b`` against ``c`` discordant pairs; 1.0 without any."""
    if b is None or c is None:
        return None
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(log)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(v - top) for v in log))


def _tail_at_least(k: int, n: int, p: float) -> float:
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(log)
    return math.exp(top) * sum(math.exp(v - top) for v in log)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a share, by bisection on the binomial tail."""
    if n <= 0:
        return 0.0, 1.0
    alpha = (1 - level) / 2

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: _tail_at_least(k, n, p) < alpha)
    high = 1.0 if k == n else solve(lambda p: 1 - _tail_at_least(k + 1, n, p) > alpha)
    return low, high


def exact_mcnemar(b: Column, c: Column) -> Column:
    """``mcnemar_p`` of two count columns, in Arrow batches."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(i), int(j)) for i, j in zip(x, y)])

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(b, c)


def exact_interval(k: Column, n: Column) -> Column:
    """Struct of low and high of ``clopper_pearson``, in Arrow batches."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(i), int(j)) for i, j in zip(x, y)], columns=["low", "high"])

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "low double, high double")(k, n)


def entropy(probabilities: Column) -> Column:
    """Natural-log entropy of an array, with terms cut at 1e-12."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.greatest(p.cast("double"), F.lit(1e-12)) * F.log(F.greatest(p.cast("double"), F.lit(1e-12))))


def hellinger(p: Column, q: Column) -> Column:
    """Hellinger distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda a, b: (F.sqrt(a) - F.sqrt(b)) * (F.sqrt(a) - F.sqrt(b))), F.lit(0.0), lambda a, x: a + x)) / math.sqrt(2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def kappa(a: Column, b: Column) -> Column:
    """Cohen's kappa of two booleans, as an aggregate; 1.0 where chance agreement is complete."""
    both = F.avg((a == b).cast("double"))
    pa, pb = F.avg(a.cast("double")), F.avg(b.cast("double"))
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.when(chance >= 1, 1.0).otherwise((both - chance) / (1 - chance))
