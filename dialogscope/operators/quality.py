"""Check batteries, observed settings, cost and catalogue roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def battery(rows: DataFrame, checks: dict[str, Column], by: str | None = None) -> DataFrame:
    """(check, failures, ok): how many rows break each condition, in one pass; a null breaks it."""
    keys = [by] if by else []
    counts = rows.groupBy(*keys).agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("failures")) for name in checks])
    return counts.select(*keys, F.inline(pairs)).withColumn("ok", F.col("failures") == 0)


def observed(rows: DataFrame, terms: list[str], lock: dict[str, str]) -> DataFrame:
    """(term, values, locked, problem): the distinct values of each term against the one that is locked."""
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).cast("string").alias("value")) for t in terms])
    seen = rows.select(F.inline(pairs)).where("value is not null").distinct().groupBy("term").agg(F.array_sort(F.collect_list("value")).alias("values"))
    locked = F.create_map(*[F.lit(x) for pair in lock.items() for x in pair])[F.col("term")]
    problem = F.when(F.size("values") > 1, "mixed").when(F.get("values", F.lit(0)) != locked, "different")
    return seen.select("term", "values", locked.alias("locked"), problem.alias("problem"))


def record_cost(turns: Column, panel: Column, guard: Column) -> dict[str, Column]:
    """Costs of one record: its turns but the runner's own, its seats, its guard, and turns without a cost.

    ``missing`` counts turns with usage and no cost that weren't cached; ``missing_any`` every turn that
    isn't the runner's and has no cost.
    """
    own = F.filter(turns, lambda t: ~F.coalesce(t["runner_authored"], F.lit(False)))
    total = lambda xs, get: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(get(x), F.lit(0.0)))
    missing = F.filter(own, lambda t: t["usage"].isNotNull() & t["usage"]["cost"].isNull() & ~F.coalesce(t["cached"], F.lit(False)))
    return {
        "turns": total(own, lambda t: t["usage"]["cost"]),
        "judge": total(F.coalesce(panel, F.array()), lambda s: s["judge_usage"]["cost"]),
        "guard": F.coalesce(guard["extra_cost_usd"], F.lit(0.0)),
        "missing": F.size(missing).cast("long"),
        "missing_any": F.size(F.filter(own, lambda t: t["usage"]["cost"].isNull())).cast("long"),
    }


def cost_report(rows: DataFrame, cost: str, missing: Column, by: list[str]) -> DataFrame:
    """Cost rounded to six places, what is missing, and whether the total is a lower bound."""
    out = rows.groupBy(*by).agg(F.round(F.sum(F.coalesce(F.col(cost), F.lit(0.0))), 6).alias("cost"), F.count_if(missing).alias("missing"))
    return out.withColumn("lower_bound", F.col("missing") > 0)


def index(rows: DataFrame, by: list[str], families: str, started: str) -> DataFrame:
    """One catalogue entry per group: rows, a count per family as a map, and the earliest start."""
    per = rows.groupBy(*by, families).agg(F.count("*").alias("n"), F.min(started).alias("s"))
    return per.groupBy(*by).agg(
        F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(families), F.col("n"))))).alias("families"), F.min("s").alias("started")
    )
