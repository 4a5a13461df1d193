"""Shared helpers of the training-data operators: table access, stage tables, hashing, Arrow text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# bytes of text handled at once inside a task; a longer document is handled on its own
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: runs once, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and those names by the old ones."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def own_name(column: str, added: list[str]) -> str:
    """The name under which a document's own column leaves an operator that adds columns ``added``."""
    return f"_own_{column}" if column.lower() in added else column


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES,
                column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of whole texts of about ``max_bytes``: (rows, bytes, offsets).

    ``bytes`` holds the texts back to back and ``offsets`` (one more than rows) their bounds; a null text is empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = np.zeros(len(col) + 1, np.int64)
        np.cumsum(np.nan_to_num(pa.compute.binary_length(col).to_numpy(zero_copy_only=False)).astype(np.int64),
                  out=sizes[1:])
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + max_bytes, "right")) - 1)
            part = pa.compute.fill_null(col.slice(lo, hi - lo), b"")
            offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
            data = part.buffers()[2]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            yield batch.slice(lo, hi - lo), data[offsets[0]:offsets[-1]], offsets - offsets[0]
            lo = hi


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on and serve other operators."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE
                ) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of back-to-back texts; a word never crosses a text's bound."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    first = np.empty(len(data), bool)
    first[0], first[1:] = True, ~inside[:-1]
    last = np.empty(len(data), bool)
    last[-1], last[:-1] = True, ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = True
    last[cuts - 1] = True
    return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64 finaliser) on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C55)


def _powers(n: int) -> np.ndarray:
    p = np.empty(max(n, 1), np.uint64)
    p[0] = 1
    p[1:] = _BASE
    return np.cumprod(p, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans disjoint and in order)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    bounds = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=bounds[1:])
    pos = np.arange(bounds[-1], dtype=np.int64) - np.repeat(bounds[:-1], lens)
    byte = data[np.repeat(starts, lens) + pos].astype(np.uint64) + np.uint64(1)
    byte *= _powers(int(lens.max()))[pos]
    return mix64(np.add.reduceat(byte, bounds[:-1]) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _BASE
        out += h[i:i + n]
    return mix64(out)


def segment_ids(offsets: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Index of the text that holds each point."""
    return np.searchsorted(offsets, points, "right") - 1
