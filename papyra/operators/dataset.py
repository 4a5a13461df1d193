"""Dataset building (D1-D8): dedup, seeded exact-count split, vocabulary, tokenization,
truncation report, causal-LM collation and optimizer-step assignment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.text import tokens
from papyra.operators.ranking import exact_rank, global_rank, keep_first, kth_key

# The end-of-text id (also the pad id) of a 50,257-entry vocabulary; the id
# below it stands for tokens outside the vocabulary. No token gets either of them.
EOS_ID = 50256
UNK_ID = EOS_ID - 1
LABEL_PAD = -100


# ---- D1 incremental dedup ------------------------------------------------------------

def new_records(batch: DataFrame, stored: DataFrame | None, key: str = "article_id",
                order_by: str = "idx") -> DataFrame:
    """Rows of ``batch`` whose ``key`` is not stored yet, first row per key.

    Keep-first is an aggregate (partial aggregation collapses duplicates
    before the shuffle); the stored ids are removed with an anti join.
    """
    first = keep_first(batch, key, order_by) if order_by in batch.columns else batch.dropDuplicates([key])
    if stored is None:
        return first
    return first.join(stored.select(key).distinct(), on=key, how="left_anti")


def newest_marker(stored: DataFrame, key: str = "article_id"):
    """The newest stored numeric id, as a driver-side scalar (non-numeric ids are ignored)."""
    return stored.agg(F.max(F.col(key).try_cast("bigint")).alias("m")).first()["m"]


# ---- D2/D3 seeded exact-count split --------------------------------------------------

def eval_count(n: int, test_size: float) -> int:
    n_eval = math.ceil(test_size * n)
    if n < 2 or n_eval >= n:
        raise ValueError(f"cannot split {n} rows with test_size={test_size}: the train split would be empty")
    return n_eval


def _seeded_key(seed: int, id_col: str):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def split_ids(samples: DataFrame, seed: int = 42, test_size: float = 0.1, id_col: str = "idx") -> DataFrame:
    """D2 on the ids alone: (id, ``split``, ``rank``, ``split_rank``).

    Eval = the first ceil(test_size * n) ids in the order of md5("seed:id"). No text is shuffled or stored.
    """
    from papyra.session import materialize
    ids = materialize(samples.select(id_col), "split-ids")            # counted and ranked: compute once
    keyed = ids.withColumn("_key", _seeded_key(seed, id_col))
    ranked, totals = exact_rank(keyed, "_key", id_col, out="rank", with_totals=True)
    n_eval = eval_count(totals.get((), 0), test_size)
    is_eval = F.col("rank") < n_eval
    return (ranked.withColumn("split", F.when(is_eval, F.lit("eval")).otherwise(F.lit("train")))
            .withColumn("split_rank", F.when(is_eval, F.col("rank")).otherwise(F.col("rank") - n_eval)).drop("_key"))


def split_boundary(samples: DataFrame, seed: int = 42, test_size: float = 0.1, id_col: str = "idx"):
    """The (key, id) of the first row of the train split, found by selection: no id is ranked, moved or stored.

    A histogram of the keys' leading digits tells which bucket holds the row; the bucket is refined until few keys are
    left. The driver receives histograms of at most 16^3 rows and one short list of keys.
    """
    keyed = samples.select(_seeded_key(seed, id_col).alias("_key"), id_col)
    return kth_key(keyed, "_key", id_col, lambda n: eval_count(n, test_size))


def eval_rows(samples: DataFrame, test_size: float = 0.1) -> tuple[int, int]:
    """D3: (train rows, eval rows) of a split, from one count."""
    n = samples.count()
    n_eval = eval_count(n, test_size)
    return n - n_eval, n_eval


def with_split(samples: DataFrame, boundary, seed: int = 42, id_col: str = "idx") -> DataFrame:
    """``split`` of each row by comparing its seeded key with the boundary; no row moves."""
    at = F.struct(_seeded_key(seed, id_col).alias("k"), F.col(id_col).alias("i"))
    bound = F.struct(F.lit(boundary[0]).alias("k"), F.lit(boundary[1]).alias("i"))
    return samples.withColumn("split", F.when(at < bound, F.lit("eval")).otherwise(F.lit("train")))


def train_eval_split(samples: DataFrame, seed: int = 42, test_size: float = 0.1,
                     id_col: str = "idx") -> DataFrame:
    """The rows with ``split``, ``rank`` (position in the seeded order) and ``split_rank`` (inside the split).

    Where the positions are not needed, ``split_boundary`` and ``with_split`` leave the texts where they are.
    """
    return samples.join(split_ids(samples, seed, test_size, id_col), id_col)


def split_sizes(samples: DataFrame, test_size: float = 0.1) -> DataFrame:
    """D3: rows per split: counted where the rows have a ``split``; else they follow from the number of rows, and nothing
    is ranked or written."""
    if "split" in samples.columns:
        return samples.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    n_train, n_eval = eval_rows(samples, test_size)
    return samples.sparkSession.createDataFrame([("train", n_train), ("eval", n_eval)], "split string, n bigint")


# ---- D4/D5 vocabulary and tokenization -------------------------------------------------

def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Corpus token frequencies (partial aggregation before the shuffle)."""
    return (texts.select(F.explode(tokens(F.col(text_col))).alias("tok"))
            .groupBy("tok").agg(F.count(F.lit(1)).alias("cnt")))


def vocabulary(texts: DataFrame, vocab_size: int | None = None, text_col: str = "text") -> DataFrame:
    """Every token with its count and id; ids follow the frequency rank (ties by token) and skip the two
    reserved ids. ``vocab_size`` keeps the most frequent tokens only (a feature, off by default)."""
    ranked = global_rank(token_counts(texts, text_col), [F.col("cnt").desc(), F.col("tok").asc()])
    if vocab_size is not None:
        ranked = ranked.where(F.col("rank") < vocab_size)
    rank = F.col("rank")
    return ranked.select("tok", "cnt", F.when(rank < UNK_ID, rank).otherwise(rank + 2).alias("id"))


TEXT_BLOCK = 4 << 20  # characters of text whose tokens ask the vocabulary together


def tokenize(samples: DataFrame, vocab: DataFrame, text_col: str = "x", unk_id: int = UNK_ID,
             id_col: str = "idx", n_blocks: int | None = None) -> DataFrame:
    """``input_ids`` per sample, text column dropped; tokens outside the vocabulary get ``unk_id``.

    Dictionary encoding by block: the distinct tokens of a block of samples ask the vocabulary, and the ids are filled
    in by array lookup, so token positions are not shuffled. Rows keep their multiplicity and their other columns. A
    null text has null ids, a text without tokens an empty list.
    """
    from papyra.operators.blocks import block_count, lookup_in_blocks, positions_in
    keep = [c for c in samples.columns if c != text_col]
    if n_blocks is None:
        n_blocks = block_count(samples, F.length(text_col).cast("bigint"), TEXT_BLOCK)
    rows = samples.select(*keep, tokens(F.col(text_col)).alias("_toks"))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("input_ids", T.ArrayType(T.IntegerType()))])

    def encode(block: pa.Table, known: pa.Table) -> pa.Table:
        lists, at = positions_in(block["_toks"], known["tok"])
        ids = pc.fill_null(known["id"].combine_chunks().take(at), unk_id).cast(pa.int32())
        bounds = np.zeros(len(lists) + 1, np.int32)
        np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=bounds[1:])
        null = np.append(lists.is_null().to_numpy(zero_copy_only=False), False)
        found = pa.ListArray.from_arrays(pa.array(bounds, mask=null), ids)
        return pa.table([*(block[c] for c in keep), found], names=[*keep, "input_ids"])

    return lookup_in_blocks(rows, ["_toks"], vocab.select("tok", "id"), encode, schema, n_blocks, [id_col])


def truncate(tok: DataFrame, max_length: int = 512) -> DataFrame:
    """Truncate to ``max_length`` ids, no padding; all-ones attention mask."""
    return (tok.withColumn("n_tokens_raw", F.size("input_ids").cast("bigint"))
            .withColumn("input_ids", F.slice("input_ids", 1, max_length))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))))


def truncation_stats(tok: DataFrame, max_length: int = 512) -> DataFrame:
    """D6 report per split: count, truncated count, lengths before/after."""
    t = truncate(tok, max_length)
    return t.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("n_tokens_raw") > max_length).cast("bigint")).alias("n_truncated"),
        F.round(F.avg("n_tokens_raw"), 6).alias("avg_len_raw"),
        F.round(F.avg(F.size("input_ids")), 6).alias("avg_len"),
        F.max("n_tokens_raw").alias("max_len_raw"),
    )


# ---- D7 causal-LM collation ------------------------------------------------------------

def collate(tok: DataFrame, batch_size: int = 8, pad_id: int = EOS_ID) -> DataFrame:
    """Consecutive ``batch_size`` rows of each split (in seeded order) form a batch;
    ids are padded to the batch maximum with ``pad_id``, labels = ids with pads
    as -100, attention mask 1/0. Each window holds one batch (bounded)."""
    b = tok.withColumn("batch_id", F.floor(F.col("split_rank") / batch_size).cast("bigint"))
    b = b.withColumn("seq_len", F.size("input_ids"))
    b = b.withColumn("batch_len", F.max("seq_len").over(Window.partitionBy("split", "batch_id")))
    pad = F.col("batch_len") - F.col("seq_len")
    return (b.withColumn("labels", F.concat("input_ids", F.array_repeat(F.lit(LABEL_PAD), pad)))
            .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), pad)))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("seq_len")),
                                                   F.array_repeat(F.lit(0), pad))))


# ---- D8 optimizer-step assignment -------------------------------------------------------

def step_assignment(train: DataFrame, epochs: int = 10, accum: int = 8, seed: int = 42,
                    id_col: str = "idx") -> DataFrame:
    """Per-epoch seeded reshuffle, micro-batches numbered across epochs,
    step = micro // accum + 1; stops after epochs * (n // accum) steps, so a
    remainder of an epoch spills into the next one."""
    from papyra.session import materialize
    train = materialize(train.select(id_col), "steps-input")   # counted and ranked: compute once
    e = train.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    e = e.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                               F.col(id_col).cast("string"))))
    r, totals = exact_rank(e, "_key", id_col, out="_r", partition_by=["epoch"], with_totals=True)
    n = totals.get((0,), 0)
    max_steps = epochs * (n // accum)
    micro = F.col("epoch").cast("bigint") * n + F.col("_r")
    return (r.select(F.col("epoch").cast("bigint").alias("epoch"), id_col, micro.alias("micro"))
            .withColumn("step", (F.floor(F.col("micro") / accum) + 1).cast("bigint"))
            .where(F.col("step") <= max_steps))
