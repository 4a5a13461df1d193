"""Benchmark decontamination by winnowing: DataFrame functions only.

Texts become words; word n-grams of length ``GRAM`` are hashed and the smallest hash of every run of ``WINDOW - GRAM +
1`` n-grams (that is, of every window of ``WINDOW`` words) is kept as its fingerprint. A window that a document shares
with an item has the same fingerprint in both, so joining fingerprints misses none; hits are extended over the windows
they stand for and compared word by word. Items of fewer words than a window are one window of their own length, for
which every document run of that length is a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, own_name, plain_columns, stage

WINDOW = 10
GRAM = 5
RUN = 16  # windows in a row that one kept fingerprint may stand for
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD), "")


def _hash_of(name: str, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(F.col(name), i + j) for j in range(n)])


def _positions(count: Column) -> Column:
    """0 .. count - 1, empty for count < 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _runs_of(n: int) -> Column:
    """Every run of ``n`` words, as a fingerprint of its own."""
    return F.transform(_positions(F.size("h") - (n - 1)), lambda i: F.struct(
        i.alias("pos"), F.lit(n).alias("n"), _hash_of("h", i, n).alias("fp")))


def fingerprints(rows: DataFrame, keys: list[str], short: list[int], sparse: bool) -> DataFrame:
    """(keys, pos, n, fp) from (keys, words).

    With ``sparse`` a run of windows with the same fingerprint is reported once per ``RUN`` windows at most;
    otherwise every window is.
    """
    hashed = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    grams = hashed.select(*keys, "h", F.transform(
        _positions(F.size("h") - (GRAM - 1)), lambda i: _hash_of("h", i, GRAM)).alias("g"))
    least = grams.select(*keys, "h", F.transform(
        _positions(F.size("g") - (WINDOW - GRAM)),
        lambda i: F.least(*[F.get(F.col("g"), i + j) for j in range(WINDOW - GRAM + 1)])).alias("m"))
    kept = _positions(F.size("m"))
    if sparse:
        kept = F.filter(kept, lambda i: (i % RUN == 0) | (F.get(F.col("m"), i) != F.get(F.col("m"), i - 1)))
    found = F.transform(kept, lambda i: F.struct(i.alias("pos"), F.lit(WINDOW).alias("n"),
                                                 F.get(F.col("m"), i).alias("fp")))
    for n in short:
        found = F.concat(found, _runs_of(n))
    return least.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, size) of the items that have words."""
    return (items.select(F.col(item_id).cast("string").alias("item_id"), _words(text).alias("words"))
            .withColumn("size", F.size("words")).where("size > 0"))


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _t, n_hit, item_ids) of the documents that hold a window of an item; item_ids sorted as strings."""
    it = stage(item_windows(items), "items")
    short = sorted(r["size"] for r in it.where(F.col("size") < WINDOW).select("size").distinct().collect())
    own = F.least(F.col("size"), F.lit(WINDOW))
    marks = stage(fingerprints(it.where(F.col("size") >= WINDOW), [], [], False).select("n", "fp")
                  .union(it.where(F.col("size") < WINDOW).select(
                      F.col("size").alias("n"), F.expr("transform(words, w -> xxhash64(w))").alias("h"))
                      .select("n", _short_hash(short)))
                  .distinct(), "item-fingerprints")
    keyed = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    found = (fingerprints(keyed.select("_id", "_t", _words("_text").alias("words")), ["_id", "_t"], short, True)
             .join(marks, ["n", "fp"], "left_semi"))
    suspects = stage(found.groupBy("_id", "_t").agg(F.collect_set(F.struct("pos", "n")).alias("at")), "suspects")
    # exact comparison of the windows that the fingerprints stand for
    s = suspects.select(F.col("_id").alias("_sid"), F.col("_t").alias("_st"), "at")
    near = (keyed.join(s, keyed["_t"].eqNullSafe(s["_st"]) & keyed["_id"].eqNullSafe(s["_sid"]))
            .select("_id", "_t", "at", _words("_text").alias("words")))
    runs = F.array_distinct(F.flatten(F.transform("at", lambda a: F.transform(
        F.sequence(a["pos"], F.when(a["n"] < WINDOW, a["pos"]).otherwise(
            F.least(a["pos"] + (RUN - 1), F.size("words") - WINDOW))),
        lambda p: F.struct(p.alias("pos"), a["n"].alias("n"))))))
    texts = near.select("_id", "_t", "words", runs.alias("runs")).select("_id", "_t", F.explode(F.transform(
        "runs", lambda r: F.struct(r["pos"].alias("pos"), r["n"].alias("n"), F.array_join(
            F.slice(F.col("words"), r["pos"] + 1, r["n"]), " ").alias("window")))).alias("r")).select("_id", "_t", "r.*")
    sought = it.select("item_id", F.explode(F.transform(
        _positions(F.col("size") - own + 1),
        lambda p: F.array_join(F.slice(F.col("words"), p + 1, own), " "))).alias("window")).distinct()
    exact = (texts.join(sought, "window").groupBy("_id", "_t")
             .agg(F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("end")))).alias("at"),
                  F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    n_hit = F.aggregate("at", zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["end"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["pos"]))).alias("n")))
    return exact.select("_id", "_t", n_hit["n"].cast("long").alias("n_hit"), "item_ids")


def _short_hash(short: list[int]) -> Column:
    """Fingerprint of a whole item of ``n`` words."""
    out = F.lit(None).cast("long")
    for n in short:
        out = F.when(F.col("n") == n, _hash_of("h", F.lit(0), n)).otherwise(out)
    return out.alias("fp")


ADDED = ["n_words", "n_hit", "item_ids"]


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus n_words, n_hit (words inside an occurring window), item_ids (items with occurring windows).

    Null and empty texts have no words. A null item id counts towards n_hit but names no item. Rows that repeat an id
    and a text get the same result. A column of ``docs`` that has the name of an added one is returned as ``_own_<name>``.
    """
    rows, names = plain_columns(docs)
    found = hits(rows, items, names[key], names[text]).withColumnsRenamed({"_id": "_hid", "_t": "_ht"})
    rows = rows.withColumn("_t", F.xxhash64(names[text])).withColumn("_n", F.size(_words(names[text])).cast("long"))
    joined = rows.join(found, rows["_t"].eqNullSafe(found["_ht"]) & rows[names[key]].eqNullSafe(found["_hid"]), "left")
    done = joined.select(*names.values(), F.col("_n").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                         F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return done.select(*[F.col(n).alias(own_name(c, ADDED)) for c, n in names.items()], *ADDED)
