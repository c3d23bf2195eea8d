"""A training corpus from ``documents``: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage works on all that the one before kept and returns the columns of ``documents``; the last returns pieces of packed
sequences. Verdicts hold for rows: a null or repeated doc_id makes no rows one document.

In every stage, empty tables give empty tables, extra columns stay as they are whatever their names, very long texts are read
whole, and nulls in other columns than those named are carried along. What a stage does with the rest:

* quality_rules: null or empty texts fail the base rules and go; a null language is a stratum of its own; repeated rows are
  judged alike, so all or none stay.
* near_duplicates: null and empty texts have no shingles and all stay; of repeated rows one stays; ties between rows of equal
  doc_id go by a hash of the text, then row number; rows with a null doc_id stay only where their group has no other.
* repeated_passages: null texts stay null; rows under one doc_id, or under null, lose nothing to each other; null is the
  smallest doc_id; n_chars is counted anew (null for null texts).
* personal_data: null texts stay null; repeated rows are masked alike; n_chars is counted anew.
* best_fit_packing: null texts are empty, so one end id; every row is packed, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import minhash, packing, pii, repeats, rules
from quern.llm.queries import LIBRARY_VOCABULARY, table
from quern.llm.shared import remove, removing, shared_dir, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.judged(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8; of each group the row with the least doc_id stays (null only if the group has no other)."""
    row = "__row" + "_" * max(map(len, docs.columns))  # no column has that name
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that every later read finds the same numbers
    groups = minhash.groups(rows, width=5, percent=80, key=row).select(F.col("doc_id").alias(row), "component_id")
    ranks = rows.select(row, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), row).alias("rank"))
    first = groups.join(ranks, row).groupBy("component_id").agg(F.min("rank")[row].alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.cleaned(docs, length=50).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, LIBRARY_VOCABULARY, size=2048, end_id=0)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: The packing stage tokenises and the personal-data stage uses a trained model, so SQL can't express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with removing(spark):  # what a stage wrote for itself goes when its result is written
            docs = written(stage(spark, docs, sf_dir), path=path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
