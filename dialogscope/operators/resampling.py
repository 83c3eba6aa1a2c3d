"""Bootstraps over sufficient statistics: a replicate is a vector of counts, never a list of drawn rows.

Units are first summed to their sufficient statistics, and equal ones become a cell with a size. A replicate draws how often each cell
counts from one multinomial distribution (in a stratum, one each), at every size: cells are dealt into chunks by a hash, each task draws
how many fall on its chunk from the chunks' sizes, all with the same random numbers, and then how they fall within it. Random numbers depend on the
seed and on the block of ``BLOCK`` replicates, so a result doesn't depend on partitions. numpy's stream for whole arrays isn't
reproduced; distributions are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a chunk, about, and replicates that are drawn at once: a task holds their product.
CHUNK = 10_000
BLOCK = 256


def drawn(sizes: np.ndarray, total: int | np.ndarray, block: int, *seed: int) -> np.ndarray:
    """``BLOCK`` draws of ``total`` units over cells of these sizes."""
    return np.random.default_rng((*seed, block)).multinomial(total, sizes / sizes.sum(), size=BLOCK)


def replicate_sums(units: DataFrame, sums: list[str], key: list[str], replicates: int, seed: int, stratum: str | None = None) -> DataFrame:
    """rep, (stratum,) and the resampled totals of ``sums``; ``units`` has a row for each unit, named by ``key`` (which only tells units apart)."""
    spark, by = units.sparkSession, [stratum] if stratum else []
    values = [F.col(c).cast("double").alias(c) for c in sums]
    cells = units.select(*by, *values).groupBy(*by, *sums).agg(F.count("*").alias("__size"))
    parts = max(1, cells.count() // CHUNK)
    cells = cells.withColumn("__chunk", F.pmod(F.xxhash64(*sums), F.lit(parts)).cast("int")).persist()
    # a row for each chunk: sizes of a stratum's chunks, in the order of their numbers
    dealt: dict = {}
    for r in cells.groupBy(*by, "__chunk").agg(F.sum("__size").alias("n")).collect():
        dealt.setdefault(r[stratum] if stratum else None, {})[r["__chunk"]] = r["n"]
    order = {name: k for k, name in enumerate(sorted(dealt, key=lambda x: (x is None, x)))}
    kind = f"{stratum} {units.schema[stratum].dataType.simpleString()}, " if stratum else ""
    schema = "rep long, " + kind + ", ".join(f"{c} double" for c in sums)

    def draw(given: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        name, number, block = (given if stratum else (None, *given))
        name = None if name is None or name != name else name
        own = dealt[name]
        numbers = sorted(own)
        sizes = np.array([own[k] for k in numbers])
        on_chunk = drawn(sizes, int(sizes.sum()), int(block), seed, 1, order[name])[:, numbers.index(number)]
        chunk = chunk.sort_values(sums)
        counts = drawn(chunk["__size"].to_numpy(), on_chunk, int(block), seed, 2, order[name], int(number))
        out = pd.DataFrame(counts @ chunk[sums].to_numpy(float), columns=sums)
        out.insert(0, "rep", int(block) * BLOCK + np.arange(BLOCK))
        if stratum:
            out.insert(1, stratum, name)
        return out[out["rep"] < replicates]

    blocks = cells.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))))
    out = blocks.groupBy(*by, "__chunk", "__block").applyInPandas(draw, schema)
    if parts > 1:
        out = out.groupBy("rep", *by).agg(*[F.sum(c).alias(c) for c in sums])
    if not stratum and not dealt:
        return spark.range(replicates).select(F.col("id").alias("rep"), *[F.lit(0.0).alias(c) for c in sums])
    return out


def interval(values: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Percentile interval (linear interpolation), standard error and two-sided p of replicates; undefined ones are skipped."""
    tail = (1 - level) / 2
    ok = values.where(F.col(value).isNotNull())
    q = F.percentile(value, F.array(F.lit(tail), F.lit(1 - tail)))
    below, above = F.avg((F.col(value) <= 0).cast("double")), F.avg((F.col(value) >= 0).cast("double"))
    out = ok.groupBy(*(by or [])).agg(q.alias("q"), F.stddev_samp(value).alias("se"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"), F.count("*").alias("replicates"))
    return out.select(*(by or []), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "se", "p", "replicates")


def index_interval(values: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Interval by places in the sorted replicates: ``floor(q * n)``, at most the last."""
    tail = (1 - level) / 2
    sorted_ = values.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.array_sort(F.collect_list(value)).alias("v"))  # replicates, a parameter
    at = lambda q: F.element_at("v", F.least(F.size("v"), F.floor(q * F.size("v")).cast("int") + 1))
    return sorted_.select(*(by or []), at(F.lit(tail)).alias("lo"), at(F.lit(1 - tail)).alias("hi"))


def cluster_difference(rows: DataFrame, cluster: str, treated: Column, flag: Column, replicates: int, seed: int = 1) -> DataFrame:
    """Risk difference (treated minus not) with clusters resampled; replicates with an empty arm are skipped."""
    hit = F.coalesce(flag, F.lit(False))
    names = ["k1", "n1", "k0", "n0"]
    units = rows.groupBy(cluster).agg(
        F.count_if(treated & hit).alias("k1"), F.count_if(treated).alias("n1"), F.count_if(~treated & hit).alias("k0"), F.count_if(~treated).alias("n0")
    )
    rd = F.try_divide("k1", "n1") - F.try_divide("k0", "n0")
    point = units.agg(*[F.sum(c).alias(c) for c in names]).select(rd.alias("rd"))
    return point.crossJoin(interval(replicate_sums(units, names, [cluster], replicates, seed).select(rd.alias("rd")), "rd"))  # one row each


def stratified_rate(rows: DataFrame, value: str, unit: list[str], replicates: int, seed: int, stratum: str) -> DataFrame:
    """Interval (by places in the sorted replicates) of each stratum's mean over resampled units."""
    units = rows.withColumn("__one", F.lit(1.0)).withColumnRenamed(value, "__sum")
    sums = replicate_sums(units, ["__sum", "__one"], unit, replicates, seed, stratum)
    return index_interval(sums.withColumn("rate", F.try_divide("__sum", "__one")), "rate", [stratum])


def paired_difference(pairs: DataFrame, a: Column, b: Column, replicates: int, seed: int = 2) -> DataFrame:
    """Difference of two rates over pairs that are resampled whole: the pairs collapse to the four cells of a multinomial."""
    cells = pairs.groupBy(a.cast("int").alias("a"), b.cast("int").alias("b")).agg(F.count("*").alias("c")).where("a is not null and b is not null")
    four = sorted((r["a"] - r["b"], r["a"], r["c"]) for r in cells.collect())  # four rows
    counts, effects = np.array([c for *_, c in four], np.int64), np.array([d for d, *_ in four], float)
    n = int(counts.sum())

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["block"]:
                d = drawn(counts, n, int(block), seed) @ effects / n if n else np.full(BLOCK, np.nan)
                yield pd.DataFrame({"d": d[: replicates - int(block) * BLOCK]})

    blocks = pairs.sparkSession.range(-(-replicates // BLOCK)).select(F.col("id").alias("block"))
    return interval(blocks.mapInPandas(draw, "d double"), "d")
