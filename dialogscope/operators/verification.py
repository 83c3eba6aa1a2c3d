"""Checks of a run against its design, its prompts and what it recorded about its models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needs_rejudging(complete: Column, status: Column, sha: Column, statuses: list[str], *, everything: bool = False, current_sha: str | None = None) -> Column:
    """Incomplete conversations never; of the others all that aren't judged under the current rubric, or those of some statuses."""
    done = (status == "judged") & (sha == F.lit(current_sha))
    wanted = ~F.coalesce(done, F.lit(False)) if everything else F.coalesce(status.isin(statuses), F.lit(False))
    return F.coalesce(complete, F.lit(True)) & wanted


def left_out(status: Column, *, smoke: str, archived: list[str], include_smokes: bool = False, include_archived: bool = False) -> Column:
    """Why a run stays out of the default view by its status line, or null."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    out = F.when(s.startswith(smoke) & F.lit(not include_smokes), "validation smoke")
    for tag in archived:
        out = out.when(s.startswith(tag) & F.lit(not include_archived), tag)
    return out


def list_argument(text: Column) -> Column:
    """struct<items, error> of a comma-separated argument: trimmed, without empty items; repeated or no items are an error."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    error = F.when(F.size(items) == 0, "empty").when(F.size(items) != F.size(F.array_distinct(items)), "duplicate")
    return F.struct(items.alias("items"), error.alias("error"))


def cross_arm(records: DataFrame, arm: str, replicate: str, has_context: Column, replicates: dict[str, int], cells: int) -> DataFrame:
    """check, ok, detail: the total, the replicates of each arm, and whether context blocks are where they belong."""
    per = records.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(replicate)).alias("reps"), F.array_sort(F.collect_set(has_context)).alias("context"))
    want = F.create_map(*[F.lit(x) for pair in replicates.items() for x in pair])
    reps_ok = F.col("reps") == F.sequence(F.lit(0), F.element_at(want, F.col("arm")) - 1)
    context_ok = F.col("context") == F.array(F.col("arm") == "context")
    rows = per.select(F.inline(F.array(
        F.struct(F.concat("arm", F.lit(" replicates")).alias("check"), reps_ok.alias("ok"), F.array_join(F.transform("reps", lambda x: x.cast("string")), ",").alias("detail")),
        F.struct(F.concat("arm", F.lit(" context")).alias("check"), context_ok.alias("ok"), F.array_join(F.transform("context", lambda x: x.cast("string")), ",").alias("detail")),
    )))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return rows.union(total.select(F.lit("total"), F.col("n") == cells * sum(replicates.values()), F.col("n").cast("string")))


def constant_hashes(rendered: DataFrame, recorded: DataFrame, cell: str, sha: str) -> DataFrame:
    """Cells whose recorded prompts have several hashes, or another one than the prompt that is rendered now."""
    seen = recorded.groupBy(cell).agg(F.array_sort(F.collect_set(sha)).alias("recorded"))
    both = rendered.select(cell, F.col(sha).alias("now")).join(seen, cell, "full")
    problem = F.when(F.col("recorded").isNull(), "unrecorded").when(F.size("recorded") > 1, "several").when(F.col("now").isNull(), "unknown cell").when(F.get("recorded", F.lit(0)) != F.col("now"), "changed")
    return both.select(cell, problem.alias("problem")).where("problem is not null")


def drift(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """slug, problem, added, removed: what differs between recorded facts about models and live ones.

    recorded: slug, accepts boolean, pinned string, providers array; live: slug, accepts, endpoint_values array<boolean>, providers.
    """
    r, n = recorded.alias("r"), live.alias("n")
    both = r.join(n, F.col("r.slug") == F.col("n.slug"), "full")
    providers = F.coalesce("n.providers", F.array().cast("array<string>"))
    unpinned = F.col("r.pinned").isNull() & (F.size(F.coalesce("n.endpoint_values", F.array().cast("array<boolean>"))) > 0)
    problems = F.array_compact(F.array(
        F.when(F.col("n.slug").isNull(), "not found"), F.when(F.col("r.slug").isNull(), "not recorded"),
        F.when(F.col("n.accepts") != F.col("r.accepts"), "acceptance changed"), F.when(F.col("r.pinned").isNotNull() & F.col("n.slug").isNotNull() & ~F.array_contains(providers, F.col("r.pinned")), "pin lost"),
        F.when(unpinned & F.exists("n.endpoint_values", lambda x: x != F.col("r.accepts")), "endpoints disagree"),
        F.when((F.size(providers) > 0) & (F.array_sort(providers) != F.array_sort("r.providers")), "routing changed"),
    ))
    gone = F.array_sort(F.array_except("r.providers", providers))
    new = F.array_sort(F.array_except(providers, F.col("r.providers")))
    return both.select(F.coalesce("r.slug", "n.slug").alias("slug"), F.explode(problems).alias("problem"), new.alias("added"), gone.alias("removed"))


def first_known(**sources: Column) -> Column:
    """struct<value, source>: the first source that isn't null, with its name."""
    out = F.lit(None)
    for i, (name, value) in enumerate(sources.items()):
        pair = F.struct(value.alias("value"), F.lit(name).alias("source"))
        out = F.when(value.isNotNull(), pair) if i == 0 else out.when(value.isNotNull(), pair)
    return out


def verdict_row_error(init: Column, tod: Column, note: Column, last: int) -> Column:
    """Why a person's verdict row isn't valid, or null; ``tod`` is text."""
    number = F.try_to_number(tod, F.lit("99")).cast("int")
    return (
        F.when(init.isNull() | ~init.isin(0, 1), "init_correct")
        .when((init == 0) & (tod != "NA"), "ToD without a correct start")
        .when((init == 1) & ~F.coalesce(number.between(2, last + 1), F.lit(False)), "ToD out of range")
        .when(F.length(F.coalesce(note, F.lit(""))) > 2000, "note too long")
    )


def commissioned(runs: DataFrame, has_records: str, has_invocation: str) -> DataFrame:
    """Runs that have records or an invocation."""
    return runs.where(F.col(has_records) | F.col(has_invocation))
