"""What a message guard makes of rule hits and of a classifier's flags: shields, order, post-rules, counters.

Everything but the rules' own matches (``text.rule_hits``) and the similarity of repeated messages is a Column expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogscope.functions import text as T

VIOLATION = "array<struct<layer:string,rule:string,evidence:string>>"

# Names of the classifier's flags and of the rules they stand for, rules that are recorded and never enforced,
# outcomes of events that leave a violation in the transcript, and the marks of a hypothetical frame.
FLAG_RULES = {
    "capitulation": "C1_capitulation", "narrative_closure": "C2_narrative_closure", "offscreen_event": "C3_offscreen_event", "symptom_change": "C4_symptom_change",
    "frame_break": "C5_frame_break", "scenario_contradiction": "C8_scenario_contradiction", "cross_family": "C6_cross_family",
}
PREMATURE = "C7_premature_barrier"
AUDIT_ONLY = ("C6_cross_family",)
SYMPTOM = "C4_symptom_change"
ACCEPTED = ("flag_accepted", "flag_accepted_original")
HYPOTHETICAL = r"(?i)\bwhat if\b|\bif\b|\beven if\b|\bin case\b|\bsuppose\b"
MODAL_QUESTION = r"(?i)^\s*(?:will|would|could|can|might|what if|what happens if)\b"


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _one(layer: str, rule: Column | str, evidence: Column) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.array(F.struct(F.lit(layer).alias("layer"), rule.alias("rule"), evidence.alias("evidence")))


def repeated(text: Column, prior: Column) -> Column:
    """The first earlier message that the text nearly repeats, or null; both of eight words or more."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, earlier: pd.Series) -> pd.Series:
        import difflib

        def first(t, others):
            if t is None or others is None:
                return None
            return next((o for o in others if o and len(o.split()) >= T.REPETITION_WORDS and difflib.SequenceMatcher(None, t, o).ratio() >= T.REPETITION), None)

        return pd.Series([first(t, o) for t, o in zip(texts, earlier, strict=True)], dtype=object)

    enough = F.size(T.words(text)) >= T.REPETITION_WORDS
    return run(F.when(enough, T.normalize(text)), F.transform(prior, lambda m: T.normalize(m)))


def deterministic(text: Column | str, instruction: Column | None = None, prior: Column | None = None) -> Column:
    """array<struct<layer, rule, evidence>> in the fixed order: pattern rules, prompt echo, gratitude wrap, repetition.

    ``instruction``: shingles of the prompt; ``prior``: messages accepted before; without them their rules don't apply.
    """
    text = F.col(text) if isinstance(text, str) else text
    out = F.transform(T.rule_hits(text), lambda x: F.struct(F.lit("deterministic").alias("layer"), x["rule"].alias("rule"), x["evidence"].alias("evidence")))
    if instruction is not None:
        echo = F.array_min(F.array_intersect(T.shingles(text), instruction))
        out = F.concat(out, F.when(echo.isNotNull(), _one("deterministic", "D3_prompt_echo", echo)).otherwise(_none()))
    wrap = F.concat_ws(" … ", F.regexp_extract(text, T.THANKS, 0), F.regexp_extract(text, T.FAREWELL, 0))
    out = F.concat(out, F.when(F.coalesce(T.thanks_and_farewell(text), F.lit(False)), _one("deterministic", "D7_gratitude_wrap", wrap)).otherwise(_none()))
    if prior is not None:
        again = repeated(text, prior)
        out = F.concat(out, F.when(again.isNotNull(), _one("deterministic", "D9_repetition", again)).otherwise(_none()))
    return out


def from_flags(flags: Column, evidence: Column, *, is_control: Column, recommended: Column, disclosed: Column) -> Column:
    """struct<violations, dropped>: a classifier's flags (names that are raised) as violations.

    A sole violation without evidence is dropped and named; a disclosure before any recommendation counts outside control
    rows, once.
    """
    names = F.create_map(*[F.lit(x) for pair in FLAG_RULES.items() for x in pair])
    order = F.array(*[F.lit(x) for x in FLAG_RULES])
    cited = lambda name: F.coalesce(F.element_at(evidence, name), F.lit(""))
    raised = F.filter(order, lambda name: F.array_contains(flags, name))
    found = F.transform(raised, lambda name: F.struct(F.lit("classifier").alias("layer"), F.element_at(names, name).alias("rule"), cited(name).alias("evidence")))
    blank = (F.size(found) == 1) & (F.trim(F.get(found, F.lit(0))["evidence"]) == "")
    early = ~is_control & F.array_contains(flags, "barrier_disclosure") & ~recommended & ~disclosed
    out = F.concat(F.when(blank, _none()).otherwise(found), F.when(early, _one("classifier", PREMATURE, cited(F.lit("barrier_disclosure")))).otherwise(_none()))
    return F.struct(out.alias("violations"), F.when(blank, F.get(found, F.lit(0))["rule"]).alias("dropped"))


def in_hypothetical(candidate: Column, evidence: Column) -> Column:
    """Whether the evidence stands in a what-if: after such a mark in its sentence, or in a modal question."""
    quote = F.regexp_replace(F.trim(F.coalesce(evidence, F.lit(""))), '^"+|"+$', "")
    at = F.position(F.lower(quote), F.lower(candidate))
    before = F.substring(candidate, F.lit(1), at - 1)
    prefix = F.regexp_extract(before, r"[^.!?\n]*$", 0)
    rest = F.substring(candidate, at, F.length(candidate))
    tail = F.regexp_extract(rest, r"^[^.!?\n]*", 0)
    ends_asking = F.substring(rest, F.length(tail) + 1, F.lit(1)) == "?"
    question = F.concat(prefix, tail).rlike(MODAL_QUESTION) & ends_asking
    return F.coalesce((quote != "") & (at > 0) & (prefix.rlike(HYPOTHETICAL) | question), F.lit(False))


def vetted(violations: Column, candidate: Column) -> Column:
    """struct<violations, audit_only, discarded>: audit-only rules apart, and symptom changes that are the sole basis and only
    hypothetical discarded."""
    audit = F.filter(violations, lambda v: v["rule"].isin(*AUDIT_ONLY))
    rest = F.filter(violations, lambda v: ~v["rule"].isin(*AUDIT_ONLY))
    sole = (F.size(rest) > 0) & F.forall(rest, lambda v: v["rule"] == SYMPTOM)
    kept = F.when(sole, F.filter(rest, lambda v: ~in_hypothetical(candidate, v["evidence"]))).otherwise(rest)
    return F.struct(kept.alias("violations"), audit.alias("audit_only"), (sole & (F.size(kept) == 0)).alias("discarded"))


def counters(events: Column) -> Column:
    """struct<n_flagged, n_cured, patient_violation, flag_accepted_after>: a guard's record of its events (kind, outcome, after_response)."""
    flags = F.filter(events, lambda e: e["kind"] == "flag")
    accepted = F.filter(events, lambda e: e["outcome"].isin(*ACCEPTED))
    return F.struct(
        F.size(flags).alias("n_flagged"), F.size(F.filter(flags, lambda e: e["outcome"] == "cured")).alias("n_cured"),
        F.exists(events, lambda e: F.coalesce(e["outcome"].isin("aborted", *ACCEPTED), F.lit(False))).alias("patient_violation"),
        F.transform(accepted, lambda e: e["after_response"]).alias("flag_accepted_after"),
    )


def corrections(
    violations: Column, clauses: dict[str, str], opening: str, closing: str, *, control: Column | None = None, control_clauses: dict[str, str] | None = None, quote: str = 'The text that broke them: "', most: int = 300
) -> Column:
    """The message that asks for another try, a line each: the opening, a clause for each rule, the first evidence, the closing.

    Clauses come in the order of the violations, each text once, rules without one are left out; where ``control`` holds, a rule's
    clause is that of ``control_clauses``, if it has one. The evidence is the first that isn't empty, cut at ``most`` characters.
    """
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    usual = lambda v: F.try_element_at(table(clauses), v["rule"])
    own = usual
    if control is not None and control_clauses:
        own = lambda v: F.coalesce(F.when(control & usual(v).isNotNull(), F.try_element_at(table(control_clauses), v["rule"])), usual(v))
    said = F.array_distinct(F.filter(F.transform(violations, own), lambda c: c.isNotNull()))
    evidence = F.get(F.filter(F.transform(violations, lambda v: v["evidence"]), lambda e: F.coalesce(e != "", F.lit(False))), F.lit(0))
    lines = F.concat(F.array(F.lit(opening)), F.transform(said, lambda c: F.concat(F.lit("- "), c)), F.array(F.concat(F.lit(quote), F.left(evidence, F.lit(most)), F.lit('"')), F.lit(closing)))
    return F.array_join(lines, "\n")  # a missing quote has no line


def other_domains(own: Column, domains: list[str]) -> Column:
    """The families that a message must not speak of: all but its own, as a list in words."""
    return F.array_join(F.filter(F.array(*[F.lit(d) for d in domains]), lambda d: d != own), ", ")
