"""A sweep over a whole store: every arm of every run in one scan, checked and compared with the stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.operators.quality import battery


def store_rows(spark: SparkSession, root: str, schema, file: str = "conversations.jsonl", fmt: str = "json") -> DataFrame:
    """All records below ``root``/run/arm/``file``, with the run and arm that their file's path names.

    The path is a column of the scan, so that each record says where it is from and nothing is read twice.
    """
    rows = spark.read.schema(schema).format(fmt).load(f"{root.rstrip('/')}/*/*/{file}")
    path = F.split(F.call_function("url_decode", F.col("_metadata.file_path")), "/")
    return rows.select("*", F.element_at(path, -3).alias("run"), F.element_at(path, -2).alias("arm"))


def arm_battery(rows: DataFrame, key: str, checks: dict[str, Column], arms: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """(run, arm, check, failures, ok): the checks on each arm of each run, and how many keys an arm has more than once.

    ``arms`` has checks for the rows of single arms; other arms pass them.
    """
    every = dict(checks)
    for arm, own in (arms or {}).items():
        every |= {name: (F.col("arm") != arm) | c for name, c in own.items()}
    repeated = rows.groupBy("run", "arm", key).agg(F.count("*").alias("n")).groupBy("run", "arm").agg(F.count_if((F.col("n") > 1) | F.col(key).isNull()).alias("failures"))
    keys = repeated.select("run", "arm", F.lit("unique keys").alias("check"), "failures", (F.col("failures") == 0).alias("ok"))
    marked = rows.withColumn("__place", F.struct("run", "arm"))
    return battery(marked, every, "__place").select("__place.run", "__place.arm", "check", "failures", "ok").union(keys)


def unknown_ids(listed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(run, arm, n): how many ids a list (run, arm, ``key``; a quarantine, say) names that the arm doesn't have."""
    known = rows.select("run", "arm", key).distinct()
    return listed.join(known, ["run", "arm", key], "left_anti").groupBy("run", "arm").agg(F.count_distinct(key).alias("n"))


def index_of(rows: DataFrame, family: str, started: str) -> DataFrame:
    """(run, arm, n, families, started): families as ``name=count`` by name, and the earliest start."""
    per = rows.groupBy("run", "arm", family).agg(F.count("*").alias("n"), F.min(started).alias("s"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(family).cast("string"), F.lit("")), F.col("n")))), lambda x: F.concat_ws("=", x["col1"], x["n"].cast("string")))
    return per.groupBy("run", "arm").agg(F.sum("n").alias("n"), F.array_join(pairs, ",").alias("families"), F.min("s").cast("string").alias("started"))


def index_differences(stored: DataFrame, built: DataFrame) -> DataFrame:
    """The entries that only the stored or only the built index has, marked by ``only``; repeated entries count."""
    columns = built.columns
    stored = stored.select(*columns)
    return stored.exceptAll(built).withColumn("only", F.lit("stored")).union(built.exceptAll(stored).withColumn("only", F.lit("built")))
