"""Judging records again: fresh judgments merged in place, in the order of the records, under a cap on spending.

Spending is a running sum over all records, which one window would put into one task. It is summed in blocks instead: bounds from
approximate quantiles of the order column say which block a record is in, blocks' sums are added up (a row a block), and each
block's window starts from the sum before it. Costs are added as decimals, so that neither blocks nor partitions change where the cap falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COST = "decimal(38,9)"
#: Blocks of a running sum: as many rows are added up in one task.
BLOCKS = 256


def running_sum(rows: DataFrame, order: str, value: Column, name: str, blocks: int = BLOCKS) -> DataFrame:
    """Adds the exact sum of ``value`` (nulls: 0) over all rows that come before by ``order``, a numeric column without nulls or repeats."""
    bounds = sorted(set(rows.approxQuantile(order, [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)))) if blocks > 1 else []
    block = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = rows.withColumns({"__block": block, "__value": F.coalesce(value.cast(COST), F.lit(0).cast(COST))})
    sums = dealt.groupBy("__block").agg(F.sum("__value").cast(COST).alias("__sum"))
    # a row a block, and each block needs the sum of those before it
    earlier = Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("__block", F.coalesce(F.sum("__sum").over(earlier).cast(COST), F.lit(0).cast(COST)).alias("__start"))
    inside = Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("__start") + F.coalesce(F.sum("__value").over(inside).cast(COST), F.lit(0).cast(COST))
    return dealt.join(F.broadcast(start), "__block").withColumn(name, spent.cast(COST)).drop("__block", "__value", "__start")


def rejudge(records: DataFrame, fresh: DataFrame, wanted: Column, *, key: str = "conversation_id", order: str, judgment: str = "judgment", max_spend: float | None = None, blocks: int = BLOCKS) -> DataFrame:
    """``records`` with fresh judgments where ``wanted`` holds, and what became of each: ``outcome``, ``error``, ``spent`` before it.

    ``fresh`` has for each key the judgment, its ``cost`` and an ``error`` (null: none); keys that it lacks are failures. Outcomes:
    untouched (not wanted), rejudged, failed (the record stays as it is, so that a later run finds it again; its cost counts) and deferred
    (spending had reached the cap before it; it stays as it is, and its cost is not spent). A wanted record with a null key fails. The order column must not
    repeat; a key that ``fresh`` repeats is an error.
    """
    clash = {"outcome", "error", "spent"} & set(records.columns)
    if clash:
        raise ValueError(f"records have columns that the merge adds: {sorted(clash)}")
    again = fresh.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if again:
        raise ValueError(f"fresh judgments repeat {[r[key] for r in again]}")
    new = fresh.select(F.col(key).alias("__key"), F.struct(F.col(judgment).alias("judgment"), F.col("cost").alias("cost"), F.col("error").alias("error")).alias("__new"))
    marked = records.withColumn("__wanted", F.coalesce(wanted, F.lit(False)))
    joined = marked.join(new, (F.col(key) == F.col("__key")) & F.col("__wanted"), "left").drop("__key")
    summed = running_sum(joined, order, F.when(F.col("__wanted"), F.col("__new.cost")), "__spent", blocks)
    over = F.lit(False) if max_spend is None else F.col("__spent") >= F.lit(max_spend).cast(COST)
    failure = F.when(F.col("__new").isNull(), "no judgment").otherwise(F.col("__new.error"))
    outcome = F.when(~F.col("__wanted"), "untouched").when(over, "deferred").when(failure.isNotNull(), "failed").otherwise("rejudged")
    out = summed.withColumns({"outcome": outcome, "error": F.when(outcome == "failed", failure)})
    now = F.when(F.col("outcome") == "rejudged", F.col("__new.judgment")).otherwise(F.col(judgment))
    columns = [now.alias(c) if c == judgment else F.col(f"`{c}`") for c in records.columns]
    cost = F.when(F.col("outcome").isin("rejudged", "failed"), F.col("__new.cost"))
    return out.select(*columns, "outcome", "error", F.col("__spent").alias("spent"), cost.alias("cost"))


def summary(merged: DataFrame) -> DataFrame:
    """One row: records, targets, rejudged, failed, deferred, whether the cap was reached, spent, and calls without a cost."""
    is_ = lambda *names: F.col("outcome").isin(*names)
    return merged.agg(
        F.count("*").alias("records"), F.count_if(~is_("untouched")).alias("targets"), F.count_if(is_("rejudged")).alias("rejudged"), F.count_if(is_("failed")).alias("failed"),
        F.count_if(is_("deferred")).alias("deferred"), F.coalesce(F.bool_or(is_("deferred")), F.lit(False)).alias("capped"),
        F.coalesce(F.sum(F.col("cost").cast(COST)), F.lit(0)).cast("double").alias("spent"), F.count_if(is_("rejudged", "failed") & F.col("cost").isNull()).alias("calls_missing_cost"),
    )


def require_vignettes(records: DataFrame, wanted: Column, vignettes: DataFrame, vignette: str = "vignette_id") -> None:
    """Fails, before anything is judged, if a wanted record's vignette isn't known."""
    known = vignettes.select(F.col("id").alias(vignette)).distinct()
    missing = records.where(F.coalesce(wanted, F.lit(False))).join(known, vignette, "left_anti").select(vignette).distinct().limit(5).collect()
    if missing:
        raise ValueError(f"vignettes not found: {sorted(str(r[0]) for r in missing)}")
