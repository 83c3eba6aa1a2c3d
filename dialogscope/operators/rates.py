"""Rates, contrasts, survival and panel statistics over flat outcome rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogscope.functions import exact
from dialogscope.functions import intervals as I


def counts(rows: DataFrame, flag: Column | str, *by: str) -> DataFrame:
    """k (rows where the flag holds) and n for each group; nulls count as not holding."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return rows.groupBy(*by).agg(F.count_if(F.coalesce(flag.cast("boolean"), F.lit(False))).alias("k"), F.count("*").alias("n"))


def with_rates(df: DataFrame) -> DataFrame:
    """Adds the rate of k in n and its Wilson interval."""
    return df.withColumn("w", I.wilson("k", "n")).select("*", I.rate("k", "n").alias("rate"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")).drop("w")


def rates_by_dimensions(rows: DataFrame, flag: str, dimensions: list[str]) -> DataFrame:
    """Overall and by each dimension, in one pass: (dimension, level, k, n, rate, lo, hi)."""
    sets = [[], *[[d] for d in dimensions]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dimensions])
    k = F.count_if(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    bits = grouped.agg(k.alias("k"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    whole = (1 << len(dimensions)) - 1
    name, level = F.lit("overall"), F.lit("all")
    for i, d in enumerate(dimensions):
        here = F.col("g") == whole - (1 << (len(dimensions) - 1 - i))
        name, level = F.when(here, d).otherwise(name), F.when(here, F.col(d).cast("string")).otherwise(level)
    return with_rates(bits.select(name.alias("dimension"), level.alias("level"), "k", "n"))


def cells(rows: DataFrame, flag: str, a: str, b: str) -> DataFrame:
    """Every pair of levels, empty ones with n = 0."""
    grid = rows.select(a).distinct().crossJoin(F.broadcast(rows.select(b).distinct()))  # two dimensions' levels
    return with_rates(grid.join(counts(rows, flag, a, b), [a, b], "left").fillna(0, ["k", "n"]))


def against_control(rows: DataFrame, flag: str, by: str, control: str) -> DataFrame:
    """Each level against the control level: difference, ratio, odds ratio, exact p."""
    groups = counts(rows, flag, by)
    base = groups.where(F.col(by) == control).select(F.col("k").alias("k0"), F.col("n").alias("n0"))
    pairs = groups.where(F.col(by) != control).crossJoin(F.broadcast(base))  # one row
    return contrast(pairs)


def contrast(pairs: DataFrame) -> DataFrame:
    """For k, n and k0, n0: rd (with interval), rr, odds ratio (with interval) and Fisher's p."""
    d = I.newcombe("k", "n", "k0", "n0")
    o = I.odds_ratio("k", F.col("n") - F.col("k"), "k0", F.col("n0") - F.col("k0"))
    out = pairs.withColumn("d", d).withColumn("o", o)
    out = out.withColumn("p", exact.fisher_exact(F.col("k"), F.col("n") - F.col("k"), F.col("k0"), F.col("n0") - F.col("k0")))
    names = [c for c in pairs.columns]
    return out.select(
        *names,
        F.col("d.rd").alias("rd"), F.col("d.lo").alias("rd_lo"), F.col("d.hi").alias("rd_hi"),
        I.risk_ratio("k", "n", "k0", "n0").alias("rr"),
        F.col("o.value").alias("odds"), F.col("o.lo").alias("odds_lo"), F.col("o.hi").alias("odds_hi"), F.col("o.corrected").alias("corrected"),
        "p",
    )


def chi_squared(rows: DataFrame, flag: str, by: str) -> DataFrame:
    """Pearson's statistic, degrees of freedom and p of flag by group, and the least expected count."""
    g = counts(rows, flag, by)
    total = g.agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"), F.count("*").alias("groups"))
    e = g.crossJoin(F.broadcast(total))  # one row
    hit, miss = F.col("n") * F.col("all_k") / F.col("all_n"), F.col("n") * (F.col("all_n") - F.col("all_k")) / F.col("all_n")
    x = F.try_divide(F.pow(F.col("k") - hit, 2), hit) + F.try_divide(F.pow(F.col("n") - F.col("k") - miss, 2), miss)
    out = e.agg(F.sum(x).alias("chi2"), (F.max("groups") - 1).cast("long").alias("df"), F.min(F.least(hit, miss)).alias("min_expected"))
    return out.withColumn("p", exact.chi2_upper_tail(F.col("chi2"), F.col("df")))


def resistance(rows: DataFrame, tod: str, last: int) -> DataFrame:
    """t, k (ToD beyond t), n and survival for t from 1 to ``last``."""
    hist = rows.where(F.col(tod).isNotNull()).groupBy(F.col(tod).alias("v")).agg(F.count("*").alias("c"))
    steps = rows.sparkSession.range(1, last + 1).select(F.col("id").alias("t"))
    joined = steps.crossJoin(F.broadcast(hist))  # at most last + 1 rows on either side
    return with_rates(joined.groupBy("t").agg(F.coalesce(F.sum(F.when(F.col("v") > F.col("t"), F.col("c"))), F.lit(0)).alias("k"), F.sum("c").alias("n")))


def hazard(rows: DataFrame, tod: str, last: int) -> DataFrame:
    """t, at_risk (ToD from t), events (ToD at t) and their ratio, for t from 2 to ``last``."""
    hist = rows.where(F.col(tod).isNotNull()).groupBy(F.col(tod).alias("v")).agg(F.count("*").alias("c"))
    steps = rows.sparkSession.range(2, last + 1).select(F.col("id").alias("t"))
    joined = steps.crossJoin(F.broadcast(hist))  # at most last + 1 rows on either side
    risk, hit = F.sum(F.when(F.col("v") >= F.col("t"), F.col("c"))), F.sum(F.when(F.col("v") == F.col("t"), F.col("c")))
    out = joined.groupBy("t").agg(F.coalesce(risk, F.lit(0)).alias("at_risk"), F.coalesce(hit, F.lit(0)).alias("events"))
    return out.withColumn("hazard", I.rate("events", "at_risk"))


def kappa_table(rows: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """One row: observed agreement, chance agreement and Cohen's kappa, weighted if asked for."""
    w = F.col(weight) if weight else F.lit(1.0)
    table = rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.sum(w).alias("w"))
    total = table.agg(F.sum("w").alias("W"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("A"))
    px = table.groupBy(F.col("x").alias("v")).agg(F.sum("w").alias("wx"))
    py = table.groupBy(F.col("y").alias("v")).agg(F.sum("w").alias("wy"))
    chance = px.join(py, "v").agg(F.coalesce(F.sum(F.col("wx") * F.col("wy")), F.lit(0.0)).alias("S"))
    both = total.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.try_divide("A", "W"), F.try_divide(F.col("S"), F.col("W") * F.col("W"))
    return both.select(po.alias("agreement"), pe.alias("chance"), I.kappa(po, pe).alias("kappa"))


def stratum_weights(sample: DataFrame, population: DataFrame, stratum: str) -> DataFrame:
    """(stratum, n, pop, weight): the population's share over the sample's count."""
    total = population.agg(F.sum("pop").alias("all_pop"))
    per = sample.groupBy(stratum).agg(F.count("*").alias("n")).join(F.broadcast(population), stratum)
    return per.crossJoin(F.broadcast(total)).select(stratum, "n", "pop", (F.col("pop") / (F.col("all_pop") * F.col("n"))).alias("weight"))
