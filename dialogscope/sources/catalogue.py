"""Dimensions that people write: vignettes, families, locks, rosters and what a store holds.

Documents are read by Spark, so that they may lie in any store it reads. Front matter and family files are read
as ``key: value`` lines; nested YAML is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.sources.records import front_matter, run_id_error

# Fixed value: the columns of a roster, all read as text.
ROSTER = "arm,conversation_id,vignette_id,family,advisor_provider,advisor_model,patient_provider,patient_model,judge_1,judge_2,judge_3,rotation_index,seed".split(",")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def key_values(text: Column) -> Column:
    """map<string, string> of the ``key: value`` lines of a text; quotes around a value go, the last of a repeated key stays."""
    pairs = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([\w-]+)\s*:", 1)), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[\w-]+\s*:(.*)$", 1)), r"^[\"']|[\"']$", "")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: later["col1"] == e["col1"]))
    return F.map_from_entries(last)


def vignettes(spark: SparkSession, folder: str, *, cohort: str | None = None, require_locked: bool = True, exclude_mental_health: bool = True) -> DataFrame:
    """id, slug, text and provenance of the ``NNN_slug.md`` files of a folder, joined to ``provenance/`` by name, sorted by id."""
    texts = _documents(spark, f"{folder}/[0-9][0-9][0-9]_*.md")
    facts = _documents(spark, f"{folder}/provenance/*.md").select("file", key_values(front_matter("content")["head"]).alias("m"))
    out = texts.join(facts, "file", "left").select(
        F.regexp_extract("file", r"^(\d{3})_(.+)\.md$", 1).alias("id"), F.regexp_extract("file", r"^(\d{3})_(.+)\.md$", 2).alias("slug"), F.regexp_replace("content", r"^\s+|\s+$", "").alias("text"),
        *[F.coalesce(F.element_at("m", k), F.lit("")).alias(k) for k in ("condition", "source_key", "cohort", "review_status")],
        *[(F.lower(F.coalesce(F.element_at("m", k), F.lit(""))) == "true").alias(k) for k in ("psychiatric", "self_harm")],
    )
    if cohort:
        out = out.where(F.col("cohort") == cohort)
    if require_locked:
        out = out.where("review_status = 'locked'")
    if exclude_mental_health:
        out = out.where("not psychiatric and not self_harm")
    return out.orderBy("id")


def family(families: DataFrame, key: str) -> DataFrame:
    """The family with this id or name."""
    return families.where((F.col("id").cast("string") == key) | (F.col("name") == key))


def unknown_roles(roles: DataFrame, providers: DataFrame) -> DataFrame:
    """Roles whose provider isn't configured: there should be none."""
    return roles.join(providers.select("provider").distinct(), "provider", "left_anti")


def lock(spark: SparkSession, path: str) -> DataFrame:
    """(term, value) of the lines below ``lock:``; fails on a file that locks nothing."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)(?:^|\n)lock:[ \t]*\n((?:[ \t]+[^\n]*(?:\n|$)|[ \t]*\n)*)", 1).alias("b"))
    terms = body.select(F.explode(key_values(F.regexp_replace("b", r"(?m)^[ \t]+", ""))).alias("term", "value"))
    if terms.isEmpty():
        raise ValueError(f"{path} locks nothing")
    return terms


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in ROSTER), enforceSchema=False)


def write_roster(rows: DataFrame, path: str) -> None:
    rows.select(*[F.col(c).cast("string").alias(c) for c in ROSTER]).write.csv(path, header=True)


def runs(spark: SparkSession, store: str) -> DataFrame:
    """run, arms and whether it has records, of every folder below ``store`` with a name that is a run id, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store).select("path")
    parts = files.select(F.split(F.regexp_extract("path", r"^(?:.*?/)?" + store.rstrip("/").rpartition("/")[2] + r"/(.+)$", 1), "/").alias("p"))
    per = parts.select(F.get("p", F.lit(0)).alias("run"), F.when(F.size("p") > 2, F.get("p", F.lit(1))).alias("arm"), (F.element_at("p", -1) == "records.jsonl").alias("records"))
    out = per.groupBy("run").agg(F.array_sort(F.collect_set("arm")).alias("arms"), F.bool_or("records").alias("has_records"))
    return out.where(run_id_error("run").isNull()).orderBy("run")


def write_json(df: DataFrame, path: str) -> None:
    """A statistics table as JSON Lines, once: an existing path is an error, NaN and infinities are null."""
    from dialogscope.functions.values import json_safe_columns

    json_safe_columns(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
