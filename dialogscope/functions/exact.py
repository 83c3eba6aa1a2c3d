"""Exact tests and numerical inversions as pandas UDFs (batches of few, aggregated rows)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables with the same margins that are no likelier than this one."""
    rows, column, total = a + b, a + c, a + b + c + d
    logs = {x: _log_choose(column, x) + _log_choose(total - column, rows - x) - _log_choose(total, rows) for x in range(max(0, rows + column - total), min(rows, column) + 1)}
    limit = logs[a] + math.log1p(1e-7)
    return min(1.0, sum(math.exp(x) for x in logs.values() if x <= limit))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    return min(1.0, sum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def binomial_test(k: int, n: int) -> float:
    """Two-sided exact test of a fair coin."""
    if n == 0:
        return 1.0
    tail = sum(math.exp(_log_choose(n, i) - n * math.log(2)) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * tail)


def mcnemar(b: int, c: int) -> float:
    return binomial_test(min(b, c), b + c)


def _root(f, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    lo = 0.0 if k == 0 else _root(lambda p: binomial_tail(k, n, p) < alpha / 2, 0.0, 1.0)
    hi = 1.0 if k == n else _root(lambda p: 1 - binomial_tail(k + 1, n, p) > alpha / 2, 0.0, 1.0)
    return lo, hi


def rate_ratio(a: int, b: int, ea: float, eb: float) -> tuple[float | None, float | None, float | None, float]:
    """Ratio of two Poisson rates, its exact conditional interval and p-value."""
    n = a + b
    if n == 0:
        return None, None, None, 1.0
    lo, hi = (math.inf if p >= 1 else p / (1 - p) * eb / ea for p in clopper_pearson(a, n))
    return (None if b == 0 else (a / ea) / (b / eb)), lo, hi, binomial_test(a, n)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by series or continued fraction."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def minimum_detectable(n1: int, n0: int, p0: float, alpha: float = 0.05, power: float = 0.80) -> float:
    """Smallest difference over ``p0`` that two groups of these sizes detect with this power."""
    want = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)

    def weak(rd: float) -> bool:
        p1 = p0 + rd
        se = math.sqrt(max(0.0, p1 * (1 - p1)) / n1 + p0 * (1 - p0) / n0)
        return se > 0 and rd / se < want

    return _root(weak, 0.0, 1 - p0)


def fisher_exact(a, b, c, d):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)], dtype=float)

    return run(a, b, c, d)


def mcnemar_exact(b, c):
    @F.pandas_udf("double")
    def run(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([mcnemar(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)

    return run(b, c)


def chi2_upper_tail(x, df):
    @F.pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(float(v), int(k)) for v, k in zip(x, df, strict=True)], dtype=float)

    return run(x, df)


def poisson_rate_ratio(a, b, ea, eb):
    """struct<ratio, lo, hi, p>."""

    @F.pandas_udf("ratio double, lo double, hi double, p double")
    def run(a: pd.Series, b: pd.Series, ea: pd.Series, eb: pd.Series) -> pd.DataFrame:
        rows = [rate_ratio(int(w), int(x), float(y), float(z)) for w, x, y, z in zip(a, b, ea, eb, strict=True)]
        return pd.DataFrame(rows, columns=["ratio", "lo", "hi", "p"], dtype=float)

    return run(a, b, ea, eb)
