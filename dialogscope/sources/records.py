"""Conversation records: schema, JSON Lines in and out, keyed reads, front matter, catalogue."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEAT = (
    "status string, init_correct variant, init_response_number variant, ToD variant, degraded_turn_quote string, rationale string, "
    "judge_provider string, judge_model string, judge_usage struct<prompt_tokens:long, completion_tokens:long, cost:double>, attempts int, raw string, error string, quote_verbatim boolean"
)
USAGE = "struct<prompt_tokens:long, completion_tokens:long, cost:double, reasoning_tokens:long, cached_tokens:long, cache_discount:double>"
TURN = (
    "speaker string, text string, advisor_response_number int, runner_authored boolean, model string, finish_reason string, truncated boolean, "
    f"usage {USAGE}, generation_id string, served_model string, provider string, cached boolean"
)
EVENT = (
    "kind string, attempt int, after_response int, outcome string, rule string, error string, violations array<struct<layer:string, rule:string, evidence:string>>, "
    "rejected_text string, correction string, rejected_cost double, candidate string, evidence variant, resample variant"
)


def _struct(fields: str) -> str:
    out, depth = [], 0
    for part in re.split(r"(, )", fields):
        out.append(part.replace(" ", ":", 1) if depth == 0 and part != ", " else part)
        depth += part.count("<") - part.count(">")
    return f"struct<{''.join(out)}>"


#: Sum-typed fields (a number, "NA" or null) stay VARIANT, so 9 and "9" are told apart.
RECORD = (
    "conversation_id string, vignette_id string, condition_id int, condition_name string, advisor_provider string, advisor_model string, replicate int, seed long, "
    f"turns array<{_struct(TURN)}>, "
    "metadata struct<complete:boolean, context_arm:string, max_turns:int, patient_framing:string, aborted_reason:string, started_at:string, ended_at:string, "
    "guard:struct<enabled:boolean, version:string, rules_sha256:string, model:string, "
    f"events:array<{_struct(EVENT)}>, n_flagged:int, n_cured:int, patient_violation:boolean, flag_accepted_after_responses:array<int>, extra_cost_usd:double>>, "
    f"judgment struct<status:string, init_correct:variant, init_response_number:variant, ToD:variant, degraded_turn_quote:string, rationale:string, aggregation:string, "
    f"panel:array<{_struct(SEAT)}>, error:string>"
)

# Names of the arms on disk, in analysis output and in rosters.
ARM_ALIASES = {"ctx": "context", "barrier_context": "context", "context": "context", "main": "main", "barrier": "main"}


def load_records(spark: SparkSession, path: str, *, strict: bool = False, schema: str = RECORD) -> DataFrame:
    """One row per line that is a record; blank lines are skipped.

    ``strict`` fails on any bad line. Otherwise bad lines stay out; ``bad_lines`` lists them.
    """
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path).where("conversation_id is not null")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), torn: the lines that aren't JSON objects; a bad last line is a torn tail."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).where("trim(text) <> ''")
    last = Window.partitionBy("file")
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False))
    marked = lines.withColumn("torn", F.col("at") == F.max("at").over(last))
    return marked.where(~ok).select("file", (F.col("at") + 1).cast("long").alias("line"), "torn")


def append_records(records: DataFrame, path: str) -> None:
    """Adds JSON Lines files; Spark commits whole files, so no line is ever torn."""
    records.write.mode("append").json(path)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key; nothing without a key."""
    others = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("r"))
    return best.select(key, *[F.col(f"r.`{c}`").alias(c) for c in others]).select(*rows.columns)


def front_matter(text: Column | str) -> Column:
    """struct<head, body>: YAML front matter between two lines that are ``---``; else no head and all the body."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r"^---[ \t]*\r?\n(?s:(.*?))\r?\n---[ \t]*(?:\r?\n|$)(?s:(.*))$"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("head"), F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def json_object(text: Column | str) -> Column:
    """The text as a VARIANT if it is one JSON object, else null."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """(arm, conversation_id) of an exclusion file ``{arm: [ids]}``, arms by their canonical names."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    names = F.create_map(*[F.lit(x) for pair in ARM_ALIASES.items() for x in pair])
    pairs = raw.select(F.explode("m").alias("arm", "ids")).select(F.coalesce(names[F.col("arm")], F.col("arm")).alias("arm"), F.explode("ids").alias("conversation_id"))
    return pairs.distinct()


def run_id_error(run_id: Column | str) -> Column:
    """Why ``<date>__<name>[__n]`` isn't a run id, or null if it is one."""
    run_id = F.col(run_id) if isinstance(run_id, str) else run_id
    parts = F.split(run_id, "__")
    return (
        F.when(~F.size(parts).isin(2, 3), "parts")
        .when(F.try_to_date(parts[0], "yyyy-MM-dd").isNull() | ~parts[0].rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(~parts[1].rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$") | (F.length(parts[1]) > 100), "name")
        .when((F.size(parts) == 3) & ~F.coalesce(F.get(parts, F.lit(2)), F.lit("")).rlike(r"^([2-9]|[1-9]\d+)$"), "ordinal")
    )


def cache_key(model: Column, messages: Column, temperature: Column, max_tokens: Column, seed: Column) -> Column:
    """sha256 of the request as JSON with sorted keys."""
    fields = {"max_tokens": max_tokens, "messages": messages, "model": model, "seed": seed, "temperature": temperature}
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}), 256)


def hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
