"""Cleaning and assembly of training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as tx

OMIT_REASONS = ("idx", "article_id", "title", "text")


def clean_articles(articles: DataFrame, ws_mode: str = "parity") -> DataFrame:
    """C1-C6 per article: adds ``teaser_clean`` and ``text_clean``.

    ``articles`` has ``idx, article_id, title, teaser, text ARRAY<STRING>``;
    a null body cleans to null (it is omitted later, instead of failing).
    """
    return (articles
            .withColumn("teaser_clean", tx.clean_teaser(F.col("teaser"), ws_mode))
            .withColumn("text_clean", tx.clean_text(F.col("text"), ws_mode)))


def omit_reason(drop_zero_idx: bool = True):
    """First failing check, in the reference's order (falsy idx/id/title/text)."""
    idx = F.col("idx")
    bad_idx = idx.isNull() | (idx == 0) if drop_zero_idx else idx.isNull()
    return (F.when(bad_idx, F.lit("idx"))
            .when(tx.is_falsy_str(F.col("article_id")), F.lit("article_id"))
            .when(tx.is_falsy_str(F.col("title")), F.lit("title"))
            .when(tx.is_falsy_str(F.col("text_clean")), F.lit("text")))


def assess(articles: DataFrame, ws_mode: str = "parity", drop_zero_idx: bool = True) -> DataFrame:
    """Cleaned articles with their ``omit_reason`` (null = kept)."""
    return clean_articles(articles, ws_mode).withColumn("omit_reason", omit_reason(drop_zero_idx))


def training_samples(articles: DataFrame, ws_mode: str = "parity",
                     drop_zero_idx: bool = True) -> DataFrame:
    """C9 + C11: kept articles as ``(idx, article_id, x)``.

    The cleaned body is computed once per article: a kept article is emitted
    through a 0-or-1 element generator instead of a filter, because a filter
    on the omission reason would be pushed below the projection and repeat
    the regex-heavy cleaning inside the predicate.
    """
    a = clean_articles(articles, ws_mode)
    out = F.struct(F.col("idx"), F.col("article_id"),
                   tx.template(F.col("title"), F.col("teaser_clean"), F.col("text_clean")).alias("x"))
    keep = F.when(omit_reason(drop_zero_idx).isNull(), F.array(out)).otherwise(F.array().cast(
        "array<struct<idx:bigint,article_id:string,x:string>>"))
    return a.select(F.explode(keep).alias("s")).select("s.idx", "s.article_id", "s.x")


def assessed_samples(articles: DataFrame, ws_mode: str = "parity", drop_zero_idx: bool = True) -> DataFrame:
    """C9-C11 in one pass: every article as ``(idx, article_id, x, omit_reason)``; ``x`` is null where it is omitted."""
    a = assess(articles, ws_mode, drop_zero_idx)
    x = tx.template(F.col("title"), F.col("teaser_clean"), F.col("text_clean"))
    return a.select("idx", "article_id", F.when(F.col("omit_reason").isNull(), x).alias("x"), "omit_reason")


def omitted(articles: DataFrame, ws_mode: str = "parity", drop_zero_idx: bool = True) -> DataFrame:
    """The omitted articles (ids and reason), cleaning each article once
    (emitted through a 0-or-1 generator, as in ``training_samples``)."""
    a = clean_articles(articles, ws_mode)
    reason = omit_reason(drop_zero_idx)
    out = F.struct(F.col("idx"), F.col("article_id"), reason.alias("omit_reason"))
    pick = F.when(reason.isNotNull(), F.array(out)).otherwise(F.array().cast(
        "array<struct<idx:bigint,article_id:string,omit_reason:string>>"))
    return a.select(F.explode(pick).alias("s")).select("s.idx", "s.article_id", "s.omit_reason")


def omission_report(articles: DataFrame, ws_mode: str = "parity",
                    drop_zero_idx: bool = True) -> DataFrame:
    """Count per omission reason, plus the kept count."""
    a = assess(articles, ws_mode, drop_zero_idx)
    return (a.groupBy(F.coalesce(F.col("omit_reason"), F.lit("kept")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def paragraph_report(articles: DataFrame, ws_mode: str = "parity") -> DataFrame:
    """C1-C4 per article: paragraphs in, dropped per filter, kept, emptied by cleaning.

    The three filter matches are computed once per paragraph (staged as flags)
    and every count reads the flags.
    """
    flags = F.transform(F.col("text"), lambda p: F.struct(
        p.alias("p"), p.rlike(tx.URL_RE).alias("u"), p.rlike(tx.EMAIL_RE).alias("e"),
        p.rlike(tx.PHONE_RE).alias("ph")))
    staged = articles.select("idx", F.col("text"), flags.alias("_f"))
    f = F.col("_f")
    kept = F.transform(F.filter(f, lambda x: x["p"].isNotNull() & ~(x["u"] | x["e"] | x["ph"])),
                       lambda x: tx.clean_paragraph(x["p"], ws_mode))
    staged = staged.select("idx", "text", "_f", kept.alias("_kept"))
    cleaned = F.col("_kept")
    return staged.select(
        "idx",
        F.size("text").cast("bigint").alias("n_in"),
        F.size(F.filter(f, lambda x: x["u"])).cast("bigint").alias("n_url"),
        F.size(F.filter(f, lambda x: ~x["u"] & x["e"])).cast("bigint").alias("n_email"),
        F.size(F.filter(f, lambda x: ~x["u"] & ~x["e"] & x["ph"])).cast("bigint").alias("n_phone"),
        F.size(cleaned).cast("bigint").alias("n_kept"),
        F.size(F.filter(cleaned, lambda p: p == "")).cast("bigint").alias("n_emptied"),
        F.coalesce(F.aggregate(cleaned, F.lit(0).cast("bigint"),
                               lambda acc, p: acc + F.length(p)), F.lit(0)).cast("bigint").alias("kept_chars"),
    )
