"""Lookups of many tokens in a large table, by blocks of rows.

Rows are dealt into blocks of bounded text; each block asks the table once for every distinct token it holds, and the
answers come back to the block, where token positions are filled by an array lookup. What is shuffled is the rows
themselves, once, and one answer per block and distinct token: token positions never move, a frequent token costs no
more than a rare one (at most one row per block), and the table is neither broadcast nor gathered.

``heavy_join`` is the native counterpart for rows that are counted already.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_block"


def block_count(rows: DataFrame, size: Column, per_block: int) -> int:
    """Blocks of about ``per_block`` of ``size`` each; at least as many as the session has task slots."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / per_block))


def lookup_in_blocks(rows: DataFrame, token_cols: list[str], table: DataFrame, fill: Callable[[pa.Table, pa.Table], pa.Table],
                     schema: T.StructType, n_blocks: int, by: list[str], key: str = "tok") -> DataFrame:
    """``fill(block of rows, answers)`` for each block: ``rows`` hold arrays of tokens (``token_cols``), ``table`` one row
    per token (``key``), and the answers are the table's rows for the distinct tokens of the block.

    Rows are dealt by a hash of the columns ``by``.
    """
    dealt = rows.withColumn(BLOCK, F.pmod(F.xxhash64(*by), F.lit(n_blocks)).cast("int"))
    every = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in token_cols]))
    asked = dealt.select(F.col(BLOCK).alias("_asked"), F.explode(every).alias(key)).distinct()  # within a task, then moved
    answers = asked.join(table, key)
    return dealt.groupBy(BLOCK).cogroup(answers.groupBy("_asked")).applyInArrow(fill, schema)


def positions_in(tokens: pa.ChunkedArray, known: pa.ChunkedArray) -> tuple[pa.ListArray, pa.Array]:
    """(the lists in one piece, the place of each of their tokens in ``known``, null where there is none)."""
    lists = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists, pc.index_in(lists.flatten(), value_set=known.combine_chunks())


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], counted: DataFrame | None = None, share: int = 1000
               ) -> DataFrame:
    """Inner join of ``left`` with ``right`` (unique in ``keys``) in which no key gathers in a task.

    Keys that hold more than 1/``share`` of the rows of ``left`` number less than ``share``: their rows of ``right`` are
    broadcast, and the others are shuffled. ``counted`` may give (keys, ``n``), the rows per key, if known.
    """
    from papyra.session import materialize
    counts = counted if counted is not None else left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") * share > total).select(*keys)            # fewer than ``share`` rows
    found = materialize(right.join(F.broadcast(heavy), keys), "heavy-keys")
    few = F.broadcast(found.select(*keys))
    return left.join(F.broadcast(found), keys).unionByName(left.join(few, keys, "left_anti").join(right, keys))
