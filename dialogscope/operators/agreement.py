"""Agreement of two raters on a stratified sample: point figures, and intervals by a bootstrap within strata.

Every figure follows from how many conversations fall on each combination of stratum and labels (a few hundred cells at most, however many
conversations): a replicate is a multinomial draw over a stratum's cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogscope.functions import intervals as I
from dialogscope.operators.resampling import BLOCK, drawn, index_interval

# Strata and kinds of decision.
KINDS = ["degraded", "init0", "held_firm"]
#: Figures that get an interval.
TARGETS = [
    "init_weighted_agree", "init_raw_kappa", "init_weighted_kappa", "kind_weighted_agree", "kind_raw_kappa", "kind_weighted_kappa", "degraded_kind_agree",
    "held_firm_kind_agree", "init0_kind_agree", "tod_exact", "tod_within_1", "human_degraded_share",
]
CELL = ["stratum", "panel_init", "human_init", "panel_kind", "human_kind", "gap"]


def decision_kind(init: Column | str, tod: Column | str, turns: Column | str) -> Column:
    """init0, degraded (a turn of degradation within the conversation) or held_firm."""
    init, tod, turns = (F.col(c) if isinstance(c, str) else c for c in (init, tod, turns))
    return F.when(init == 0, "init0").when(F.coalesce(tod <= turns, F.lit(False)), "degraded").otherwise("held_firm")


def label_cells(rows: DataFrame) -> DataFrame:
    """``CELL`` and n, from stratum, turns and each rater's panel_ or human_ init and tod (null where there is none).

    ``gap`` is 0, 1 or 2 (more), the distance of the two turns of degradation where both raters see one.
    """
    kinds = {f"{who}_kind": decision_kind(f"{who}_init", f"{who}_tod", "turns") for who in ("panel", "human")}
    labelled = rows.withColumns(kinds)
    both = (F.col("panel_kind") == "degraded") & (F.col("human_kind") == "degraded")
    gap = F.when(both, F.least(F.abs(F.col("panel_tod") - F.col("human_tod")), F.lit(2)).cast("int"))
    return labelled.withColumn("gap", gap).groupBy(*CELL).agg(F.count("*").alias("n"))


def figures(cells: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All figures for each group of cells.

    weights: stratum and weight (of one conversation). Raw figures count conversations alike; a kappa is null where chance agreement is 1,
    a share where it has no conversations.
    """
    n, w = F.col("n"), F.col("n") * F.col("weight")
    total = lambda what, where=None: F.coalesce(F.sum(what if where is None else F.when(where, what)), F.lit(0.0))
    same = {x: F.col(f"panel_{x}") == F.col(f"human_{x}") for x in ("init", "kind")}
    one = (F.col("panel_init") == 1) & (F.col("human_init") == 1)
    falls = {who: F.col(f"{who}_kind") == "degraded" for who in ("panel", "human")}

    def kappa(what: Column, label: str, values: list, where: Column | None = None, labels: dict | None = None) -> Column:
        given = where if where is not None else F.lit(True)
        labels = labels or {who: F.col(f"{who}_{label}") for who in ("panel", "human")}
        whole = total(what, given)
        share = lambda cond: F.try_divide(total(what, given & cond), whole)
        chance = sum((share(labels["panel"] == v) * share(labels["human"] == v) for v in values), F.lit(0.0))
        return I.kappa(share(labels["panel"] == labels["human"]), chance)

    out: dict[str, Column] = {"n": F.sum(n).cast("long")}
    for label, values in (("init", [0, 1]), ("kind", KINDS)):
        out |= {f"{label}_raw_agree": F.try_divide(total(n, same[label]), total(n)), f"{label}_weighted_agree": total(w, same[label])}
        out |= {f"{label}_{how}_kappa": kappa(what, label, values) for how, what in (("raw", n), ("weighted", w))}
    for s in KINDS:
        mine = F.col("stratum") == s
        out |= {f"{s}_n": total(n, mine).cast("long")} | {f"{s}_{x}_agree": F.try_divide(total(n, mine & same[x]), total(n, mine)) for x in ("init", "kind")}
    out |= {"both_init_n": total(n, one).cast("long"), "both_init_raw_agree": F.try_divide(total(n, one & (falls["panel"] == falls["human"])), total(n, one))}
    out |= {"both_init_raw_kappa": kappa(n, "", [True, False], one, falls)}
    gaps = F.col("gap").isNotNull()
    out |= {"tod_n": total(n, gaps).cast("long"), "tod_exact": F.try_divide(total(n, F.col("gap") == 0), total(n, gaps)), "tod_within_1": F.try_divide(total(n, F.col("gap") <= 1), total(n, gaps))}
    out |= {f"{who}_degraded_share": total(w, falls[who]) for who in ("panel", "human")}
    weighted = cells.join(F.broadcast(weights.select("stratum", "weight")), "stratum")  # a row for each stratum
    return weighted.groupBy(*(by or [])).agg(*[c.cast("double").alias(k) if not k.endswith("n") else c.alias(k) for k, c in out.items()])


def bootstrap(cells: DataFrame, weights: DataFrame, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """target, lo, hi (by places in the sorted replicates) and the number of replicates in which it is defined."""
    spark = cells.sparkSession
    held = cells.orderBy(*CELL).toPandas().astype(object)  # combinations of labels
    held = held.where(held.notna(), None)
    strata = [g for _, g in held.groupby("stratum", sort=True)]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in map(int, batch["block"]):
                for k, stratum in enumerate(strata):
                    sizes = stratum["n"].to_numpy(int)
                    counts = drawn(sizes, int(sizes.sum()), block, seed, k)[: replicates - block * BLOCK]
                    for cell, n in zip(stratum.to_dict("records"), counts.T, strict=True):
                        yield pd.DataFrame({"rep": block * BLOCK + pd.RangeIndex(len(n)), **{c: pd.Series([cell[c]] * len(n), dtype=object) for c in CELL}, "n": n})

    schema = "rep long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*CELL, "n").schema.fields)
    blocks = spark.range(-(-replicates // BLOCK)).select(F.col("id").alias("block"))
    stats = figures(blocks.mapInPandas(draw, schema).where("n > 0"), weights, ["rep"])
    long = stats.unpivot("rep", TARGETS, "target", "value")
    counts = long.where("value IS NOT NULL").groupBy("target").agg(F.count("*").alias("replicates"))
    return index_interval(long, "value", ["target"], level).join(counts, "target")
