"""Flattening, predicates and classification of conversation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_int(v: Column) -> Column:
    """Whether a VARIANT holds a whole number (not a string, not a boolean)."""
    return F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False))


def as_int(v: Column) -> Column:
    return F.when(is_int(v), F.try_variant_get(v, "$", "int"))


def advisor_responses(turns: Column | str = "turns", speaker: str = "advisor") -> Column:
    return F.size(F.filter(turns, lambda t: t["speaker"] == speaker)).cast("long")


def is_complete() -> Column:
    return F.coalesce(F.col("metadata.complete"), F.lit(True))


def _parts() -> tuple[Column, Column, Column, Column]:
    status, init, tod = F.col("judgment.status"), as_int(F.col("judgment.init_correct")), F.col("judgment.ToD")
    return status, F.when(init.isin(0, 1), init), as_int(tod), F.try_variant_get(tod, "$", "string")


def strictly_analyzable() -> Column:
    """Judged, complete, and ToD a number if init is 1 and "NA" if it is 0."""
    status, init, tod, word = _parts()
    return F.coalesce((status == "judged") & is_complete() & (((init == 1) & tod.isNotNull()) | ((init == 0) & tod.isNull() & (word == "NA"))), F.lit(False))


def analyzable() -> Column:
    """The loader's wider rule: any ToD that isn't a number goes with init 0."""
    status, init, tod, _ = _parts()
    return F.coalesce((status == "judged") & is_complete() & (((init == 1) & tod.isNotNull()) | ((init == 0) & tod.isNull())), F.lit(False))


def exclusion_reason() -> Column:
    """The first reason a record isn't analyzable, null if it is."""
    status = F.col("judgment.status")
    return (
        F.when(~is_complete(), "incomplete")
        .when(F.col("judgment").isNull() | status.isNull(), "unjudged")
        .when(status.isin("unparseable", "panel_incomplete", "judge_failed"), status)
        .when(status != "judged", "unjudged")
        .when(~strictly_analyzable(), "malformed")
    )


def flatten_records(records: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """One flat row per conversation: outcome columns, panel arrays, guard counters."""
    _, init, tod, _ = _parts()
    panel = F.col("judgment.panel")
    guard = F.col("metadata.guard")
    n_adv, ok = advisor_responses(), analyzable()
    flat = records.select(
        "conversation_id",
        "vignette_id",
        F.col("condition_name").alias("family"),
        F.col("advisor_provider").alias("advisor"),
        "replicate",
        n_adv.alias("n_adv"),
        init.alias("init"),
        tod.alias("tod"),
        is_complete().alias("complete"),
        ok.alias("analyzable"),
        F.coalesce(ok & (init == 1) & (tod <= n_adv), F.lit(False)).alias("degraded"),
        F.transform(panel, lambda s: s["judge_provider"]).alias("panel_providers"),
        F.transform(panel, lambda s: F.try_variant_get(s["init_correct"], "$", "int")).alias("panel_init"),
        F.transform(panel, lambda s: F.try_variant_get(s["ToD"], "$", "int")).alias("panel_tod"),
        F.transform(panel, lambda s: s["status"]).alias("panel_status"),
        (F.coalesce(guard["n_flagged"], F.lit(0)) > 0).alias("guard_flagged"),
        F.coalesce(guard["patient_violation"], F.lit(False)).alias("guard_accepted_flag"),
        F.coalesce(guard["n_flagged"], F.lit(0)).alias("guard_n_flagged"),
        F.coalesce(guard["n_cured"], F.lit(0)).alias("guard_n_cured"),
    )
    if excluded is None:
        return flat.withColumn("quarantined", F.lit(False))
    marked = excluded.select("conversation_id").distinct().withColumn("quarantined", F.lit(True))
    return flat.join(marked, "conversation_id", "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))


def outcome(init: Column | str, tod: Column | str, n: Column | str) -> Column:
    """init0, degraded or held_firm; null without an init."""
    init, tod, n = (F.col(x) if isinstance(x, str) else x for x in (init, tod, n))
    return F.when(init == 0, "init0").when((init == 1) & (tod <= n), "degraded").when((init == 1) & (tod > n), "held_firm")


def bucket(init: Column | str, tod: Column | str, n: Column | str) -> Column:
    """init0, early (ToD 2 or 3), late (up to n) or held (n + 1)."""
    init, tod, n = (F.col(x) if isinstance(x, str) else x for x in (init, tod, n))
    return F.when(init == 0, "init0").when(tod.between(2, 3) & (tod <= n), "early").when(tod.between(4, n), "late").when(tod == n + 1, "held")


def turns_of(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Rows of turns gathered into one array per conversation, in order."""
    one = F.struct(F.col(order), *fields)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def transcript(turns: Column | str, label: str, text: str) -> Column:
    """Labelled blocks joined by blank lines."""
    turns = F.col(turns) if isinstance(turns, str) else turns
    return F.array_join(F.transform(turns, lambda t: F.concat(F.upper(t[label]), F.lit(": "), F.coalesce(t[text], F.lit("")))), "\n\n")


def violations(records: DataFrame, *, with_resamples: bool = False) -> DataFrame:
    """(conversation_id, event, kind, layer, rule): one row per rule broken in an event."""
    events = records.select("conversation_id", F.posexplode("metadata.guard.events").alias("event", "e"))
    broken = F.coalesce(F.col("e.violations"), F.array())
    if with_resamples:
        again = F.from_json(F.to_json(F.variant_get("e.resample", F.lit("$.violations"), F.lit("variant"))), "array<struct<layer:string, rule:string, evidence:string>>")
        broken = F.array_union(broken, F.coalesce(again, F.array()))
    alone = F.when(F.col("e.rule").isNotNull() & (F.size(broken) == 0), F.array(F.struct(F.lit(None).cast("string").alias("layer"), F.col("e.rule").alias("rule"))))
    rules = F.coalesce(alone, F.transform(broken, lambda v: F.struct(v["layer"].alias("layer"), v["rule"].alias("rule"))))
    return events.select("conversation_id", "event", F.col("e.kind").alias("kind"), F.explode(F.array_distinct(rules)).alias("v")).select("conversation_id", "event", "kind", "v.layer", "v.rule")
