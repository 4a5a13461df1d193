"""Corpus pipeline: the documents table through quality filtering, deduplication, decontamination and tokenisation.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next stage's ``docs``. All stages but the last return the columns of
``documents``. ``run`` applies them to the whole table.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from papyra.llm.common import stage, table  # noqa: E402
from papyra.session import ship_package  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier accepts."""
    from papyra.llm.quality import accepted, learn_from_texts
    return accepted(docs.select(*COLUMNS), learn_from_texts(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the repeats of three-line windows; a document of which only blanks are left goes."""
    from papyra.llm.line_dedup import dedup_lines
    left = dedup_lines(docs.select(*COLUMNS)).where("n_removed = 0 or length(trim(text)) > 0")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", "text", "lang", "source", changed.alias("n_chars"))


def _same_row(rows: DataFrame, found: DataFrame) -> Column:
    """Whether id and text hash are the same, null ids included."""
    return rows["_h"].eqNullSafe(found["_t"]) & rows["doc_id"].eqNullSafe(found["_id"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that the n-gram Jaccard join links: the one of the smallest (doc_id, text hash).

    A row without an id comes after all others; of rows that agree in both, the one of the smallest lang, source and
    n_chars stays. Rows without words link with nothing and stay.
    """
    from papyra.llm.jaccard import jaccard_components
    ship_package(spark)
    rows = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("t"))
    found = jaccard_components(rows.select(key.alias("_key"), "text"), "_key").where("n_shingles > 0")
    known = (found.select("_key", (~F.col("component_id").eqNullSafe(F.col("_key"))).alias("gone")).groupBy("_key")
             .agg(F.max("gone").alias("gone"), F.count("gone").alias("n")).where("gone or n > 1")
             .select(F.col("_key.id").alias("_id"), F.col("_key.t").alias("_t"), "gone"))
    known = stage(known, "near-duplicates")
    left = rows.join(known, _same_row(rows, known), "left_anti").select(*COLUMNS)
    again = known.where("not gone")
    if again.isEmpty():
        return left
    # rows that repeat an id and a text, and are the first of their component
    first = (rows.join(again, _same_row(rows, again), "left_semi").groupBy("doc_id", "_h")
             .agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r")).select("doc_id", "r.*"))
    return left.unionByName(first.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    from papyra.llm.decontaminate import hits
    found = stage(hits(docs, table(spark, sf_dir, "benchmark")).select("_id", "_t"), "contaminated")
    rows = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    return rows.join(found, _same_row(rows, found), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the token ids with their checks."""
    from papyra.llm.sentencepieces import encode_texts, read_model
    ship_package(spark)
    return encode_texts(docs.select(*COLUMNS), read_model())


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("SentencePiece tokens", tokens)]
ORACLE_SQL = None  # the classifier and the tokenizer are not expressible in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
