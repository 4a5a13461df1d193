"""Sinks for raw and processed records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession

# error conditions that mean "nothing stored yet"; any other read error is raised
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_if_stored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    return read_reader(spark.read.format(fmt), path)


def read_reader(reader: DataFrameReader, path: str) -> DataFrame | None:
    """What a reader finds at ``path``; None if nothing is stored there."""
    try:
        return reader.load(path)
    except AnalysisException as e:
        if e.getCondition() in NOTHING_STORED:
            return None
        raise


def write_records(df: DataFrame, path: str, mode: str = "dedup", key: str = "article_id",
                  fmt: str = "json") -> None:
    """Write records; non-ASCII text is written as-is (UTF-8).

    ``mode="append"`` reproduces the reference's append-on-every-run (reruns
    duplicate rows). The default ``"dedup"`` appends only keys not yet stored
    (an anti join against the existing sink), so a rerun changes nothing.
    ``store_new`` is the way for writers that may fail half-way or run side by side.
    """
    writer_mode = "append"
    if mode == "dedup":
        from papyra.operators.dataset import new_records
        spark = df.sparkSession
        stored = read_if_stored(spark, path, fmt)
        df = new_records(df, None if stored is None else stored.select(key), key=key)
    elif mode == "overwrite":
        writer_mode = "overwrite"
    elif mode != "append":
        raise ValueError(f"unknown sink mode {mode!r}")
    df.write.mode(writer_mode).format(fmt).save(path)


def store_new(df: DataFrame, path: str, tag: str, key: str = "article_id", order_by: str = "idx", index=None) -> DataFrame:
    """S6 + D1: commit the rows of ``df`` with new keys under ``tag`` and enter their keys into the id index.

    The first row of a key (by ``order_by``) counts. Ids are looked up in the index (``operators.idindex.IdIndex``, by
    default at ``<path>-ids``), so the cost follows the batch and not the sink. A write that died is written again under
    its tag, with the same result; a committed tag is left alone. Returns the committed rows.
    """
    from papyra.operators.idindex import IdIndex
    from papyra.operators.ranking import keep_first
    from papyra.sources.commits import commit
    index = index or IdIndex(df.sparkSession, f"{path.rstrip('/')}-ids")
    fresh = index.missing(df, key, tag)
    rows = keep_first(df, key, order_by).join(fresh, key, "left_semi").select(*df.columns)
    stored = commit(rows, path, tag)
    index.add(stored, tag, key)
    return stored
