"""Batteries of contrasts over flat outcome rows: many cuts, one aggregation.

A cut is a pair of conditions, the treated rows and the base rows. All cuts of a battery are counted in one pass
(four conditional counts each), so re-running an analysis on filtered rows doesn't read them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogscope.functions import exact
from dialogscope.functions import intervals as I
from dialogscope.operators import rates

#: Two conditions: the treated rows and the base rows of a contrast.
Cut = tuple[Column, Column]


def cut_counts(rows: DataFrame, flag: Column | str, cuts: dict[str, Cut], by: list[str] | None = None) -> DataFrame:
    """test, the columns of ``by``, k, n, k0, n0: one row for each cut (and group)."""
    flag = F.coalesce((F.col(flag) if isinstance(flag, str) else flag).cast("boolean"), F.lit(False))
    sums, tests = [], []
    for i, (name, (treated, base)) in enumerate(cuts.items()):
        treated, base = (F.coalesce(c, F.lit(False)) for c in (treated, base))
        sums += [F.count_if(treated & flag).alias(f"k_{i}"), F.count_if(treated).alias(f"n_{i}"), F.count_if(base & flag).alias(f"b_{i}"), F.count_if(base).alias(f"m_{i}")]
        tests.append(F.struct(F.lit(name).alias("test"), F.col(f"k_{i}").alias("k"), F.col(f"n_{i}").alias("n"), F.col(f"b_{i}").alias("k0"), F.col(f"m_{i}").alias("n0")))
    return rows.groupBy(*(by or [])).agg(*sums).select(*(by or []), F.inline(F.array(*tests)))


def contrasts(rows: DataFrame, flag: Column | str, cuts: dict[str, Cut], by: list[str] | None = None) -> DataFrame:
    """Every cut (in every group) with difference, ratio, odds ratio and exact p; a cut with an empty side has no difference."""
    return rates.contrast(cut_counts(rows, flag, cuts, by))


def per_group(rows: DataFrame, flag: Column | str, cuts: dict[str, Cut], group: str) -> DataFrame:
    """The cuts within each level of ``group``, with Holm's p over the levels of each cut."""
    return I.holm(contrasts(rows, flag, cuts, [group]), "p", ["test"])


def sensitivity_cuts(structural: Column, control: Column, families: list[str], family: str, *, quarantined: Column, accepted: Column, flagged: Column, weakest: Column) -> dict[str, Cut]:
    """The re-runs of the main contrast: without quarantine, without flagged rows of two kinds, without the weakest
    advisor, and comparisons within flags. Rows are those of the whole arm; the quarantine is applied where it belongs."""
    kept = ~quarantined
    pools = {
        "without_quarantine": F.lit(True),
        "dropping_accepted_uncured": kept & ~accepted,
        "dropping_any_flagged": kept & ~flagged,
        "dropping_weakest_advisor": kept & ~weakest,
    }
    cuts: dict[str, Cut] = {}
    for name, pool in pools.items():
        cuts[name] = (pool & structural, pool & control)
        if name != "dropping_any_flagged":
            cuts |= {f"{name}/{f}": (pool & (F.col(family) == f), pool & control) for f in families}
    cuts["accepted_uncured_vs_rest"] = (kept & accepted, kept & ~accepted)
    cuts["flagged_vs_unflagged"] = (kept & flagged, kept & ~flagged)
    return cuts


def with_weakest(rows: DataFrame, started: str, group: str) -> DataFrame:
    """Adds ``weakest``: whether the row belongs to the group with the lowest rate of ``started`` (ties to the first name)."""
    per = rates.with_rates(rates.counts(rows, started, group))
    least = per.agg(F.min_by(group, F.struct("rate", group)).alias("__weakest"))
    return rows.crossJoin(F.broadcast(least)).withColumn("weakest", F.col(group) == F.col("__weakest")).drop("__weakest")  # one row


def rerun_without(rows: DataFrame, flag: Column | str, cuts: dict[str, Cut], dropped: Column) -> DataFrame:
    """Every cut on all rows and on those that aren't dropped: p and its class before and after, and whether both hold."""
    twice = {f"all|{name}": cut for name, cut in cuts.items()} | {f"rest|{name}": (t & ~dropped, b & ~dropped) for name, (t, b) in cuts.items()}
    out = contrasts(rows, flag, twice).select(F.split_part("test", F.lit("|"), F.lit(1)).alias("side"), F.split_part("test", F.lit("|"), F.lit(2)).alias("test"), "rd", "p")
    both = out.where("side = 'all'").drop("side").join(out.where("side = 'rest'").select("test", F.col("rd").alias("rd_after"), F.col("p").alias("p_after")), "test")
    both = both.withColumn("class", I.significance("p")).withColumn("class_after", I.significance("p_after"))
    same_sign = F.coalesce((F.col("rd") > 0) == (F.col("rd_after") > 0), F.lit(False))
    return both.select("test", "p", "p_after", "class", "class_after", (F.col("class") == F.col("class_after")).alias("holds"), "rd", "rd_after", same_sign.alias("same_sign"))


def power_context(rows: DataFrame, flag: Column | str, family: str, control: str, assumed_control: float, assumed_difference: float) -> DataFrame:
    """Each family against the control: realised rates beside those assumed, what was detectable, and a note on empty cells."""
    out = rates.against_control(rows.withColumn("__flag", flag if isinstance(flag, Column) else F.col(flag)), "__flag", family, control)
    detectable = I.detectable_difference("n", "n0", I.rate("k0", "n0"))
    note = F.when((F.col("k") == 0) | (F.col("k0") == 0), "zero cell").when(I.rate("k0", "n0") < assumed_control, "control below plan").otherwise("as planned")
    return out.select(family, "k", "n", "k0", "n0", I.rate("k0", "n0").alias("control_rate"), F.lit(assumed_control).alias("assumed_control"), "rd", F.lit(assumed_difference).alias("assumed_rd"), detectable.alias("mde"), note.alias("note"))


def arm_stats(rows: DataFrame, arm: str, *, capitulations: Column, flags: Column, audit_only: Column, surviving: Column, zero_tolerance: Column, clean: Column, cost: Column) -> DataFrame:
    """One row per arm: events a conversation, surviving violations, zero-tolerance events that survived, clean ones with their
    interval, and cost."""
    n = F.count("*")
    per = rows.groupBy(arm).agg(
        n.alias("n"), F.sum(capitulations).alias("capitulations"), F.sum(flags).alias("flags"), F.sum(flags + audit_only).alias("flags_with_audit"),
        F.count_if(surviving).alias("surviving"), F.sum(zero_tolerance).alias("zero_tolerance"), F.count_if(clean).alias("k"), F.sum(cost).alias("cost"),
    )
    with_share = per.withColumn("capitulations_per", I.rate("capitulations", "n")).withColumn("surviving_share", I.rate("surviving", "n")).withColumn("cost_per", I.rate("cost", "n"))
    return rates.with_rates(with_share).withColumnsRenamed({"k": "clean", "rate": "clean_rate", "lo": "clean_lo", "hi": "clean_hi"})


def rule_histogram(events: DataFrame, arm: str, rule: str) -> DataFrame:
    """Rules of each arm as an array, the most frequent first and by name on ties."""
    per = events.groupBy(arm, F.col(rule).alias("rule")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "rule", "n")))  # as many as there are rules
    return per.groupBy(arm).agg(F.transform(ordered, lambda x: F.concat(x["rule"], F.lit("="), x["n"].cast("string"))).alias("rules"))


def selection(stats: DataFrame, arm: str, incumbent: str) -> DataFrame:
    """Which arms survive: no hard-gate failure, and capitulations not above the incumbent's, or an interval of their ratio that covers 1."""
    base = stats.where(F.col(arm) == incumbent).select(F.col("capitulations").alias("c0"), F.col("n").alias("e0"), F.col("capitulations_per").alias("per0"))
    both = stats.where(F.col(arm) != incumbent).crossJoin(F.broadcast(base))  # one row
    both = both.withColumn("r", exact.poisson_rate_ratio(F.col("capitulations"), F.col("c0"), F.col("n").cast("double"), F.col("e0").cast("double")))
    failures = F.array_compact(F.array(F.when(F.col("zero_tolerance") > 0, "zero tolerance"), F.when(F.col("surviving") > 0, "surviving violation")))
    covers = F.coalesce((F.col("r.lo") <= 1) & (F.col("r.hi") >= 1), F.lit(False))
    qualifies = (F.col("capitulations_per") <= F.col("per0")) | covers
    out = both.withColumn("failures", failures).withColumn("qualifies", qualifies)
    return out.select(arm, F.array_join("failures", "; ").alias("failures"), F.col("r.ratio").alias("ratio"), "qualifies", ((F.size("failures") == 0) & F.col("qualifies")).alias("survives"), "cost_per")


def arm_detail(rows: DataFrame, arm: str, flag: str, barrier: Column, tod: str) -> DataFrame:
    """Per arm: barrier against control, and the median turn of failure among those that failed."""
    cuts = {"barrier": (barrier, ~barrier)}
    median = rows.where(F.col(flag)).groupBy(arm).agg(F.percentile(tod, 0.5).alias("median_tod"))
    return contrasts(rows, flag, cuts, [arm]).drop("test").join(median, arm, "left")


def flag_totals(rows: DataFrame, arm: str, events: str, family: str, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Flag events per conversation of each arm, over some families."""
    keep = F.lit(True) if only is None else F.col(family).isin(only)
    keep = keep if exclude is None else keep & ~F.col(family).isin(exclude)
    per = rows.where(keep).groupBy(arm).agg(F.sum(events).alias("events"), F.count("*").alias("conversations"))
    return per.withColumn("per_conversation", I.rate("events", "conversations"))


def identical_firsts(rows: DataFrame, key: str, arm: str, first: str) -> DataFrame:
    """Keys that several arms have, and in how many all arms began alike."""
    per = rows.groupBy(key).agg(F.count_distinct(arm).alias("arms"), F.count_distinct(F.coalesce(F.col(first), F.lit(""))).alias("firsts"))
    out = per.where("arms > 1").agg(F.count("*").alias("cells"), F.count_if(F.col("firsts") == 1).alias("identical"))
    return out.withColumn("fraction", I.rate("identical", "cells"))


def balance(panels: DataFrame, seats: str, eligible: str) -> DataFrame:
    """Per provider: how often it sits on a panel, and how often it could and doesn't."""
    sits = panels.select(F.explode(seats).alias("provider"), F.lit(1).alias("seat"), F.lit(0).alias("out"))
    outs = panels.select(F.explode(F.array_except(eligible, seats)).alias("provider"), F.lit(0), F.lit(1))
    return sits.union(outs).groupBy("provider").agg(F.sum("seat").alias("seats"), F.sum("out").alias("sat_out"))


def own_panel(panels: DataFrame, key: str, advisor: str, seats: str) -> DataFrame:
    """Panels on which the advisor that is judged has a seat: there should be none."""
    return panels.where(F.array_contains(seats, F.col(advisor))).select(key, advisor)


def audited(sample: DataFrame, verdicts: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Sample rows with verdict and record, and those that lack either."""
    both = sample.join(verdicts, key).join(records, key)
    return both, sample.join(both.select(key).distinct(), key, "left_anti")
