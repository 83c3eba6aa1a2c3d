"""Grids, set comparisons, ordered samples and running state, each as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid(*dimensions: DataFrame, replicates: int = 1) -> DataFrame:
    """Every combination of small dimension tables and replicates from 0."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(F.broadcast(d))  # levels of a design
    return out.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def remaining(cells: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Cells that are still to do."""
    return cells.join(done, key, "left_anti")


def set_comparison(expected: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """(key, status): missing, extra or duplicate keys, by one full outer join."""
    e = expected.groupBy(key).agg(F.count("*").alias("e"))
    h = have.groupBy(key).agg(F.count("*").alias("h"))
    status = F.when(F.col("h").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("h") > 1, "duplicate")
    return e.join(h, key, "full_outer").select(key, status.alias("status")).where("status is not null")


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of the left whose value on the right is missing or another."""
    r = right.select(key, F.col(value).alias("now"))
    joined = left.select(key, F.col(value).alias("then")).join(r, key, "left")
    return joined.where(F.col("now").isNull() | (F.col("now") != F.col("then"))).select(key, "then", "now")


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change): new, same or changed, for every row after."""
    b = before.select(key, F.col(value).alias("before"), F.lit(True).alias("__had"))
    joined = after.select(key, F.col(value).alias("after")).join(b, key, "left")
    change = F.when(F.col("__had").isNull(), "new").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return joined.select(key, "before", "after", change.alias("change"))


def round_robin(rows: DataFrame, group: str, order: Column, *, within: list[str] | None = None) -> DataFrame:
    """Adds ``place``: the turn in which a row comes up when groups take turns."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*(within or []), group).orderBy(order)))


def quota_sample(rows: DataFrame, stratum: str, group: str, order: Column, quotas: dict[str, int]) -> DataFrame:
    """Per stratum, its quota of rows, groups taking turns; a stratum without a quota gives none."""
    turns = round_robin(rows, group, order, within=[stratum])
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy("place", group)))
    limit = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col(stratum)]
    return ranked.where(F.col("rank") <= limit)


def latched(rows: DataFrame, key: str, order: str | list[str], flag: Column, name: str) -> DataFrame:
    """Adds whether the flag has held in an earlier row of the key."""
    before = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.max(F.coalesce(flag, F.lit(False))).over(before), F.lit(False)))


def spend_replay(rows: DataFrame, order: str, cost: str, cap: float, *, by: str, fail_closed: bool = False) -> DataFrame:
    """Adds ``spent`` before each row and whether it still runs: spending under the cap so far and,
    if asked for, no missing cost before it. Each ``by`` has its own budget."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce(F.col(cost), F.lit(0.0))).over(before), F.lit(0.0))
    runs = spent < cap
    if fail_closed:
        runs = runs & ~F.coalesce(F.max(F.col(cost).isNull()).over(before), F.lit(False))
    return rows.withColumn("spent", spent).withColumn("runs", runs)


def first_free_ordinal(used: DataFrame, ordinal: str = "n") -> DataFrame:
    """The smallest number from 2 that isn't used."""
    taken = used.where(F.col(ordinal) >= 2).select(F.col(ordinal).alias("n")).distinct()
    after = taken.select((F.col("n") + 1).alias("n")).union(used.sparkSession.range(2, 3).select(F.col("id").alias("n")))
    return after.join(taken, "n", "left_anti").agg(F.min("n").alias("n"))


# Fixed value: the order in which arms run.
ARM_ORDER = ["main", "context"]


def arm_states(expected: DataFrame, finished: DataFrame, key: str, arm: str = "arm") -> DataFrame:
    """(arm, expected, missing, complete): how many distinct cells of each arm are neither done nor failed for good."""
    done = finished.select(arm, key).distinct().withColumn("__done", F.lit(True))
    joined = expected.select(arm, key).distinct().join(done, [arm, key], "left")
    return joined.groupBy(arm).agg(F.count("*").alias("expected"), F.count_if(F.col("__done").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


def arms_to_continue(states: DataFrame, requested: list[str] | None = None, arm: str = "arm") -> list[str]:
    """The incomplete arms in their order; a request narrows them, and one for an arm that doesn't exist or was never begun is an error."""
    complete = {r[arm]: r["complete"] for r in states.where(F.col(arm).isin(ARM_ORDER)).select(arm, "complete").collect()}  # a row an arm
    unknown = [a for a in requested or [] if a not in ARM_ORDER]
    never = [a for a in requested or [] if a not in complete]
    if unknown or never:
        raise ValueError(f"unknown arms {unknown}; the arms are {ARM_ORDER}" if unknown else f"arms that the run never had: {never}")
    return [a for a in ARM_ORDER if a in complete and not complete[a] and (requested is None or a in requested)]
