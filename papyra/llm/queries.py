"""Registered queries of the training-data operators (production parameters, whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracle import ORACLE


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode_texts, read_model
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, read_model(), ids=False)


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import ppm_scores
    return ppm_scores(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines
    left = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", "n_spans",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derive, responses_of_pages
    made = derive(responses_of_pages(table(spark, sf_dir, "pages")))
    return made.select(F.col("source_key").alias("page_id"), "kind", "record_id", F.col("identifier").alias("refers_to"),
                       "target", "title", "lang", F.size("links").cast("long").alias("n_links"),
                       "source_payload_digest", "block_digest", F.length("block").cast("long").alias("block_bytes"),
                       F.sha2("record", 256).alias("record_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_ids
    return language_ids(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ppm_scores, op2_line_dedup, op3_quality_classifier,
                                   op4_jaccard_join, op5_toxicity, op6_suffix_dedup,
                                   op7_sentencepiece, op8_nearest_neighbours, op9_warc_derivatives, op10_benchmark_decontamination,
                                   op11_prefix_trie, op12_hard_negatives, op13_language_id)}


__all__ = ["ORACLE", "QUERIES"]
