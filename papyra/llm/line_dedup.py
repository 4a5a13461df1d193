"""Line dedup: windows of three consecutive lines that occur elsewhere are removed, except where they come first.

DataFrame functions only. Lines are hashed, windows of three line hashes are counted over all documents, and every
occurrence but the first (by document id, then text hash, then position) marks its three lines; marks are merged per
document and the marked lines dropped. Windows of blank lines only are not repeats. Documents of fewer than three
lines have no window. Rows that repeat both an id and a text are one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, plain_columns

SIZE = 3


def _lines(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("_id", F.col(key)).withColumn("_t", F.xxhash64(text))


def _window(name: str, i: Column) -> Column:
    return F.xxhash64(*[F.get(F.col(name), i + j) for j in range(SIZE)])


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _t, pos, w1, w2): every window that is not blank, by a 128-bit hash of its lines."""
    hashed = (_lines(_keyed(docs, key, text), text).where(F.size("_lines") >= SIZE)
              .select("_id", "_t",
                      F.transform("_lines", lambda x: F.xxhash64(x)).alias("a"),
                      F.transform("_lines", lambda x: F.xxhash64(F.lit("b"), x)).alias("b"),
                      F.transform("_lines", lambda x: F.length(F.trim(x)) > 0).alias("filled")))
    starts = F.filter(F.sequence(F.lit(0), F.size("a") - SIZE),
                      lambda i: F.get(F.col("filled"), i) | F.get(F.col("filled"), i + 1) | F.get(F.col("filled"), i + 2))
    return (hashed.select("_id", "_t", F.explode(F.transform(
        starts, lambda i: F.struct(i.alias("pos"), _window("a", i).alias("w1"), _window("b", i).alias("w2")))).alias("w"))
        .select("_id", "_t", "w.pos", "w.w1", "w.w2"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _t, covered): sorted line numbers that later occurrences of repeated windows cover."""
    found = windows(docs, key, text)
    place = F.struct("_id", "_t", "pos")
    firsts = (found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
              .where("n > 1").select("w1", "w2", "first"))
    later = (found.join(firsts, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
             .groupBy("_id", "_t").agg(F.collect_set("pos").alias("at")))
    cover = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "at", lambda p: F.sequence(p, p + SIZE - 1)))))
    return later.select("_id", "_t", cover.alias("covered"))


ADDED = ["n_lines", "n_removed", "n_spans"]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text left over, plus n_lines, n_removed and n_spans (maximal removed runs).

    A null text stays null with no lines; an empty text has none either. A column of ``docs`` that has the name of an
    added one is returned as ``_own_<name>``.
    """
    rows, names = plain_columns(docs)
    body = names[text]
    marked = repeated_lines(rows, names[key], body).select(
        F.col("_id").alias("_mid"), F.col("_t").alias("_mt"), F.col("covered").alias("_covered"))
    rows = _keyed(rows, names[key], body)
    joined = rows.join(marked, rows["_t"].eqNullSafe(marked["_mt"]) & rows["_id"].eqNullSafe(marked["_mid"]), "left")
    cut = _lines(joined, body)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    runs = F.filter("_covered", lambda x, j: (j == 0) | (F.get(F.col("_covered"), j - 1) != x - 1))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    left = F.when(F.col("_covered").isNull(), F.col(body)).otherwise(left)
    done = cut.select(
        *[(left if c == text else F.col(n)).alias(n) for c, n in names.items()],
        F.when(F.length(F.coalesce(F.col(body), F.lit(""))) > 0, F.size("_lines")).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col("_covered").isNull(), 0).otherwise(F.size("_covered")).cast("long").alias("n_removed"),
        F.when(F.col("_covered").isNull(), 0).otherwise(F.size(runs)).cast("long").alias("n_spans"))
    return done.select(*[F.col(n).alias(own_name(c, ADDED)) for c, n in names.items()], *ADDED)
