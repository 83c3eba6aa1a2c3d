"""Corpus pipeline: quality classifier, quality rules, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last give the columns of ``documents``. Rows that share a
doc_id (or have none) stay or go together; rows without one stay whole in line dedup and are never near
duplicates of others. An empty table passes through every stage, and columns beyond those of ``documents`` (whatever
they are called) are dropped by the first stage. Texts are worked on whole, of any length.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogscope.llm import divergence_rules, kn_quality, line_dedup, packing, partenum
from dialogscope.llm.common import read, scratch, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _of_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.

    A null or empty text has its end token alone and is judged like any other; rows that share a doc_id and language
    are judged together, as are those without a doc_id; a language without trusted held-out documents keeps everything.
    """
    judged = kn_quality.classify(docs, read(spark, sf_dir, "labels"))
    gone = judged.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("lang").alias("gone_lang"))
    # the rejected are few, so the join's other side is small; texts stay where they are if it can be broadcast
    here = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.coalesce(docs["lang"], F.lit("")) == gone["gone_lang"])
    return _of_documents(docs.join(gone, here, "left_anti"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    A null, empty or short text has too few words and goes; of rows that share a doc_id (or have none) all go if one does.
    """
    gone = divergence_rules.judge(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return _of_documents(docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat; a document may be left with an empty text.

    A null text becomes an empty one; rows that share a doc_id lose the same lines; rows without one stay whole. The last
    doc_id of a repeated line keeps it.
    """
    return _of_documents(line_dedup.dedup(docs))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Texts without words, and rows without a doc_id, all stay; rows that repeat the smallest doc_id stay together.
    """
    found = stored(partenum.components(docs), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rest = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    return _of_documents(rest)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; a null or empty text is one piece, the closing id."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlives=1)
    return STAGES[-1][1](spark, docs, sf_dir)
