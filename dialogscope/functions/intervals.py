"""Closed-form statistics as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054
#: Fixed value: the 80 % normal quantile.
Z80 = 0.8416212335729143


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def rate(k: Column | str, n: Column | str) -> Column:
    """k / n, null where n is 0."""
    return F.try_divide(_c(k).cast("double"), _c(n).cast("double"))


def wilson(k: Column | str, n: Column | str, z: float = Z95) -> Column:
    """struct<lo, hi>: the Wilson interval, (0, 1) where n is 0."""
    n = _c(n).cast("double")
    p = rate(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / d
    lo = F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0))
    hi = F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def newcombe(k1, n1, k0, n0, z: float = Z95) -> Column:
    """struct<rd, lo, hi>: difference of two rates with its hybrid-score interval; null if a group is empty."""
    p1, p0, w1, w0 = rate(k1, n1), rate(k0, n0), wilson(k1, n1, z), wilson(k0, n0, z)
    rd = p1 - p0
    lo = rd - F.sqrt(F.pow(p1 - w1["lo"], 2) + F.pow(w0["hi"] - p0, 2))
    hi = rd + F.sqrt(F.pow(w1["hi"] - p1, 2) + F.pow(p0 - w0["lo"], 2))
    clamp = lambda x: F.when(rd.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return F.struct(rd.alias("rd"), clamp(lo).alias("lo"), clamp(hi).alias("hi"))


def odds_ratio(a, b, c, d, z: float = Z95) -> Column:
    """struct<value, lo, hi, corrected>: Woolf interval; half is added to all cells if any is 0."""
    a, b, c, d = (_c(x).cast("double") for x in (a, b, c, d))
    corrected = F.least(a, b, c, d) == 0
    a, b, c, d = (x + F.when(corrected, 0.5).otherwise(0.0) for x in (a, b, c, d))
    value = a * d / (b * c)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.struct(value.alias("value"), (value * F.exp(-z * se)).alias("lo"), (value * F.exp(z * se)).alias("hi"), corrected.alias("corrected"))


def risk_ratio(k1, n1, k0, n0) -> Column:
    """Ratio of two rates, null if the second has no events or a group is empty."""
    return F.try_divide(rate(k1, n1), rate(k0, n0))


def kappa(agreement: Column | str, chance: Column | str) -> Column:
    """Cohen's kappa from observed and chance agreement, null where chance is 1."""
    po, pe = _c(agreement), _c(chance)
    return F.when(pe < 1, (po - pe) / F.when(pe < 1, 1 - pe))


def holm_step(p: Column | str, family: list[str]) -> Column:
    """Holm's step-down product of each p-value; ``holm`` takes its running maximum."""
    p = _c(p)
    m, place = F.count(F.lit(1)).over(Window.partitionBy(*family)), F.row_number().over(Window.partitionBy(*family).orderBy(p))
    return F.least(F.lit(1.0), (m - place + 1) * p)


def holm(df: DataFrame, p: str, family: list[str], name: str = "p_holm") -> DataFrame:
    """Adds Holm's adjusted p-value within the columns of ``family``."""
    by = Window.partitionBy(*family).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__step", holm_step(p, family)).withColumn(name, F.max("__step").over(by)).drop("__step")


def detectable_difference(n1, n0, p0, power_z: float = Z80) -> Column:
    """Smallest difference over ``p0`` that groups of these sizes detect (two-sided 5 %, power 80 %): the root of
    d^2 = z^2 * (p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) with p1 = p0 + d, at most 1 - p0; null where a group is empty."""
    n1, n0, p0 = _c(n1).cast("double"), _c(n0).cast("double"), _c(p0)
    zz = (Z95 + power_z) ** 2
    b = F.try_divide(zz * (1 - 2 * p0), n1)
    a, c = 1 + F.try_divide(F.lit(zz), n1), zz * p0 * (1 - p0) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0))
    return F.when((n1 > 0) & (n0 > 0), F.least(1 - p0, (b + F.sqrt(b * b + 4 * a * c)) / (2 * a)))


def significance(p: Column | str, alpha: float = 0.05) -> Column:
    """"significant", "not-significant" or, for a null, "unavailable"."""
    p = _c(p)
    return F.when(p.isNull() | F.isnan(p), "unavailable").when(p < alpha, "significant").otherwise("not-significant")


def decision(lo: Column | str, hi: Column | str, margin: float = 0.10) -> Column:
    """What an interval of a difference calls for, against plus and minus ``margin``."""
    lo, hi = _c(lo), _c(hi)
    return (
        F.when(lo.isNull() | hi.isNull(), "insufficient data")
        .when(lo > margin, "re-run recommended")
        .when(hi < -margin, "investigate")
        .when((lo >= -margin) & (hi <= margin), "disclose and publish")
        .otherwise("inconclusive")
    )


def estimate_usd(cells: Column | str, per_cell: float = 0.0782, reserve: float = 1.30) -> Column:
    """Forecast cost of so many conversations."""
    return _c(cells) * F.lit(per_cell * reserve)


def headroom(cap: Column | str, estimate: Column | str) -> Column:
    """Cap over estimate; infinite where the estimate isn't positive."""
    e = _c(estimate)
    return F.when(e <= 0, float("inf")).otherwise(F.try_divide(_c(cap), e))


def conversation_seed(base: Column | str, replicate: Column | str, family: Column | str) -> Column:
    return (_c(base) + _c(replicate) + _c(family) * 1000).cast("long")
