"""Committed writes. Rows go to a folder of their own, and a manifest row, written last, makes them count.

A folder without a manifest row (a writer that died half-way) is never read, a write under a tag that is committed
already is skipped, and writers under different tags do not disturb each other. The manifest lies beside the data, one
small file per commit.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MANIFEST_DDL = "tag STRING, folder STRING, n_rows BIGINT, fingerprint STRING, at TIMESTAMP"


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}-commits"


def commits(spark: SparkSession, path: str) -> list[Row]:
    """The manifest rows of ``path`` in the order of their commits."""
    from papyra.sources.sinks import read_if_stored
    found = read_if_stored(spark, _manifest(path))
    return [] if found is None else sorted(found.collect(), key=lambda r: (r["at"], r["folder"]))


def committed(spark: SparkSession, path: str, tag: str, fingerprint: str | None = None) -> Row | None:
    """The last commit of a tag (with this fingerprint, if one is given)."""
    found = [c for c in commits(spark, path) if c["tag"] == tag and fingerprint in (None, c["fingerprint"])]
    return found[-1] if found else None


def commit(df: DataFrame, path: str, tag: str, fingerprint: str = "", again: bool = False) -> DataFrame:
    """Write ``df`` under ``tag`` unless the tag is committed with this fingerprint; returns the committed rows.

    ``again`` writes in any case, into a folder of its own; the last commit of a tag counts.
    """
    spark = df.sparkSession
    known = None if again else committed(spark, path, tag, fingerprint)
    if known is not None:
        return spark.read.schema(df.schema).parquet(known["folder"])
    folder = f"{path.rstrip('/')}/commit={folder_name(tag)}{'-' + fingerprint if fingerprint else ''}"
    if again:
        folder += f"-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(folder)
    stored = spark.read.schema(df.schema).parquet(folder)
    row = spark.createDataFrame([(tag, folder, stored.count(), fingerprint)],
                                "tag STRING, folder STRING, n_rows BIGINT, fingerprint STRING")
    row.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(_manifest(path))
    return stored


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes when a file below ``paths`` is added, removed or written again; only file metadata is read."""
    parts = []
    for path in paths:
        files = spark.read.parquet(path).select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
        r = files.distinct().agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("*")).alias("x")).first()
        parts.append(f"{r['n']}:{r['x']}")
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:16]


def folder_name(tag: str) -> str:
    """A tag as a folder name."""
    return quote(tag, safe="")


def read_committed(spark: SparkSession, path: str, schema, key: str | None = None) -> DataFrame:
    """The committed rows of all tags, with their ``tag``. With ``key``, rows that two concurrent writers stored twice
    count once (the one of the smallest tag)."""
    last = {c["tag"]: c["folder"] for c in commits(spark, path)}
    if not last:
        return spark.createDataFrame([], schema).withColumn("tag", F.lit(None).cast("string"))
    rows = None
    for tag, folder in last.items():
        part = spark.read.schema(schema).parquet(folder).withColumn("tag", F.lit(tag))
        rows = part if rows is None else rows.unionByName(part)
    if key is None:
        return rows
    from papyra.operators.ranking import keep_first
    return keep_first(rows, key, "tag")
