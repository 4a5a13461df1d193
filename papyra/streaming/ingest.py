"""Incremental ingest of newly landed raw-article files with Structured Streaming.

Every article is ingested once, across restarts, reruns and new checkpoints.
De-duplication state lives in an id index beside the sink (``<sink>-ids``), not
in the streaming state store, so it does not grow without bound in memory, and
a micro-batch reads only the index buckets of its own ids, however large the
sink is. Each micro-batch writes its own ``batch_id=<query id>-<N>`` folder with
overwrite and enters its ids under that name, so a batch replayed after a
failure replaces its own output instead of duplicating it, and a new query
never overwrites another one's batches. A sink without an index (or with one
that was lost) gets one from its stored ids first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.clean import training_samples
from papyra.operators.idindex import IdIndex
from papyra.operators.ranking import keep_first
from papyra.sources.readers import CORRUPT_COL, RAW_ARTICLE_DDL, normalise_text
from papyra.sources.sinks import read_if_stored


def ingest(spark: SparkSession, landing: str, sink: str, checkpoint: str,
           max_files_per_trigger: int | None = None, body_mode: str = "lines",
           ws_mode: str = "parity", bucket_ids: int = 65_536) -> None:
    """Run the ingest until every landed file is processed (``availableNow``).

    ``bucket_ids`` is the size of the id index's buckets. Malformed lines go to ``<sink>-malformed``, one folder per micro-batch.
    """
    reader = (spark.readStream.schema(f"{RAW_ARTICLE_DDL}, {CORRUPT_COL} STRING")
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(landing)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # the query's id is kept in the checkpoint: the same over restarts, another one for a new checkpoint
        own = f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        bad = batch.where(F.col(CORRUPT_COL).isNotNull()).select("idx", CORRUPT_COL)
        bad.write.mode("overwrite").parquet(f"{sink.rstrip('/')}-malformed/batch_id={own}")
        good = normalise_text(batch.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL), body_mode)
        index = IdIndex(session, f"{sink.rstrip('/')}-ids", bucket_ids)
        if not index.exists:
            stored = read_if_stored(session, sink)
            if stored is not None:
                index.add(stored.where(F.col("batch_id").cast("string") != own), "earlier")
        fresh = index.missing(good, tag=own)
        samples = keep_first(training_samples(good.join(fresh, "article_id", "left_semi"), ws_mode=ws_mode), "article_id", "idx")
        samples.write.mode("overwrite").parquet(f"{sink}/batch_id={own}")
        index.add(session.read.schema("article_id STRING").parquet(f"{sink}/batch_id={own}"), own)

    q = (raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def ingested(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).select("idx", "article_id", "x")
