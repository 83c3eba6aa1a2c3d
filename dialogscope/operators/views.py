"""What a reader is shown of a record: judges' seats and guard events with long texts cut, as nested columns.

Arrays are worked on in place; nothing is exploded or shuffled. Missing arrays give empty ones, a guard that was off gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many characters of a text are shown.
TEXT, EVIDENCE, ERROR, RESAMPLE = 4000, 600, 300, 300

_VIOLATION = "array<struct<layer:string, rule:string, evidence:string>>"


def whole_number(v: Column) -> Column:
    """A VARIANT that is a whole number, else null: neither texts nor booleans count."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "long"))


def _cut(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def seats(panel: Column) -> Column:
    """The seats of a panel: each one's verdict and rationale, and its error cut; raw replies and prompts go."""

    def one(m: Column) -> Column:
        init = whole_number(m["init_correct"])
        named = [m[f"judge_{x}"].alias(x) for x in ("provider", "model")]
        return F.struct(
            *named, m["status"].alias("status"), F.when(init.isin(0, 1), init).alias("init"), m["init_response_number"].alias("irn"), whole_number(m["ToD"]).alias("tod"), m["ToD"].alias("tod_raw"),
            F.coalesce(m["degraded_turn_quote"], F.lit("")).alias("quote"), F.coalesce(m["rationale"], F.lit("")).alias("rationale"), m["attempts"].alias("attempts"),
            m["quote_verbatim"].alias("quote_verbatim"), _cut(m["error"], ERROR).alias("error"),
        )

    return F.transform(F.coalesce(panel, F.array()), one)


def _violations(broken: Column) -> Column:
    return F.transform(F.coalesce(broken, F.array()), lambda v: F.struct(v["layer"].alias("layer"), v["rule"].alias("rule"), _cut(v["evidence"], EVIDENCE).alias("evidence")))


def events(guard_events: Column) -> Column:
    """Guard events with drafts, evidence and resamples cut. Evidence is a list, of one where it was a text; a resample that is no object is ``note``."""

    def one(e: Column) -> Column:
        kind, again = F.schema_of_variant(e["evidence"]), F.schema_of_variant(e["resample"])
        evidence = F.when(kind.startswith("ARRAY"), F.try_variant_get(e["evidence"], "$", "array<string>")).when(kind != "VOID", F.array(F.try_variant_get(e["evidence"], "$", "string")))
        inside = F.try_variant_get(e["resample"], "$.violations", _VIOLATION)
        resample = F.when(again.startswith("OBJECT"), F.struct(_cut(F.try_variant_get(e["resample"], "$.accepted_text", "string"), TEXT).alias("accepted_text"), _violations(inside).alias("violations")))
        texts = [_cut(e[c], TEXT).alias(c) for c in ("rejected_text", "correction", "candidate")]
        return F.struct(
            *[e[c].alias(c) for c in ("kind", "after_response", "attempt", "outcome", "rule")], _cut(e["error"], EVIDENCE).alias("error"), e["rejected_cost"].alias("rejected_cost"),
            _violations(e["violations"]).alias("violations"), *texts, F.transform(evidence, lambda x: _cut(x, EVIDENCE)).alias("evidence"), resample.alias("resample"),
            F.when(~again.startswith("OBJECT") & (again != "VOID"), _cut(F.try_variant_get(e["resample"], "$", "string"), RESAMPLE)).alias("note"),
        )

    return F.transform(F.coalesce(guard_events, F.array()), one)


def guard(g: Column) -> Column:
    """The guard of a record with its events; null where it was off."""
    counts = [F.coalesce(g[c], F.lit(0)).alias(c) for c in ("n_flagged", "n_cured")]
    shown = F.struct(
        *[g[c].alias(c) for c in ("model", "version", "rules_sha256")], *counts, F.coalesce(g["patient_violation"], F.lit(False)).alias("violation"),
        F.coalesce(g["flag_accepted_after_responses"], F.array()).alias("flag_turns"), g["extra_cost_usd"].alias("extra_cost_usd"), events(g["events"]).alias("events"),
    )
    return F.when(F.coalesce(g["enabled"], F.lit(False)), shown)


def record_views(records: DataFrame) -> DataFrame:
    """conversation_id, panel and guard of every record."""
    return records.select("conversation_id", seats(F.col("judgment.panel")).alias("panel"), guard(F.col("metadata.guard")).alias("guard"))
