"""An index of stored ids, so that a batch finds out which of its ids are new without reading the sink.

Ids lie in hash buckets of bounded size: when the ids outgrow the buckets, a new generation with more buckets is written
and then committed (each id is rewritten a logarithmic number of times). Each bucket has a Bloom filter, kept as rows of
64-bit words. A batch reads the filter words of its own buckets; ids that a filter rules out are new, and only buckets
with ids that it lets through are opened. So a batch of b ids reads at most b buckets of bounded size, however many ids
are stored.

Every write carries a tag. The batch that is being written again after a failure leaves its own tag out of the question,
so it finds the same ids new as before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES = 4  # bits of a filter that an id sets
MANY = 2000  # buckets beyond which a generation is read whole and filtered
GENERATION_DDL = "generation INT, n_buckets INT, n_ids BIGINT"


@dataclass
class IdIndex:
    """``bucket_ids``: ids of a bucket at most, on average; ``bits_per_id``: size of a filter."""
    spark: SparkSession
    path: str
    bucket_ids: int = 65_536
    bits_per_id: int = 16
    generation: int = field(default=-1, init=False)
    n_buckets: int = field(default=0, init=False)
    n_ids: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        from papyra.sources.sinks import read_if_stored
        self.path = self.path.rstrip("/")
        found = read_if_stored(self.spark, f"{self.path}/generations")
        if found is not None:  # a row per generation and one per write
            last = found.groupBy("generation", "n_buckets").agg(F.sum("n_ids").alias("n_ids")).orderBy(F.desc("generation")).first()
            self.generation, self.n_buckets, self.n_ids = last["generation"], last["n_buckets"], last["n_ids"]

    @property
    def exists(self) -> bool:
        return self.generation >= 0

    def missing(self, ids: DataFrame, key: str = "article_id", tag: str | None = None) -> DataFrame:
        """The distinct values of ``ids`` that are not stored (those written under ``tag`` do not count); null is never new
        nor stored."""
        asked = ids.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct()
        if not self.exists:
            return asked.select(F.col("id").alias(key))
        asked = self._placed(asked)
        words = self._read("bits", "word int, bits bigint", _buckets(asked))
        if words is None:
            return asked.select(F.col("id").alias(key))
        filters = (words if tag is None else words.where(F.col("tag") != tag)).groupBy("bucket", "word").agg(
            F.bit_or("bits").alias("bits"))
        probes = asked.select("id", "bucket", F.explode(self._bits(F.col("id"))).alias("at"))
        probes = probes.select("id", "bucket", _word("at").alias("word"), _mask("at").alias("mask"))
        hit = (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).cast("int")
        maybe = (probes.join(filters, ["bucket", "word"], "left").groupBy("id", "bucket")
                 .agg(F.min(F.coalesce(hit, F.lit(0))).alias("hit")).where("hit = 1").select("id", "bucket"))
        opened = _buckets(maybe)
        stored = self._read("ids", "id string", opened) if opened else None
        if stored is None:
            return asked.select(F.col("id").alias(key))
        known = (stored if tag is None else stored.where(F.col("tag") != tag)).select("bucket", "id")
        return asked.join(known, ["bucket", "id"], "left_anti").select(F.col("id").alias(key))

    def add(self, ids: DataFrame, tag: str, key: str = "article_id") -> None:
        """Store ids under a tag; the batch that calls this writes its rows first."""
        named = ids.select(F.col(key).cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()
        n = named.count()
        if not self.exists:
            self._generation(0, max(1, math.ceil(n / self.bucket_ids)))
        if n:
            self._write(self._placed(named).withColumn("tag", F.lit(tag)))
            self._commit(n)
        if self.n_ids > self.bucket_ids * self.n_buckets:
            self.grow()

    def grow(self) -> None:
        """Rewrite the ids with as many buckets as they need, at least twice as many as before."""
        n = self.n_buckets
        while n * self.bucket_ids < 2 * self.n_ids:
            n *= 2
        old = self._read("ids", "id string", None).select("id", "tag").distinct()
        self._generation(self.generation + 1, max(n, 2 * self.n_buckets))
        self._write(self._placed(old))
        self._commit(old.count())

    # ---- layout: gen-<n>/ids/bucket=<b>, gen-<n>/bits/bucket=<b>, generations ----

    def _folder(self, kind: str) -> str:
        return f"{self.path}/gen-{self.generation}/{kind}"

    def _generation(self, generation: int, n_buckets: int) -> None:
        self.generation, self.n_buckets, self.n_ids = generation, n_buckets, 0

    def _commit(self, n: int) -> None:
        self.n_ids += n
        row = self.spark.createDataFrame([(self.generation, self.n_buckets, n)], GENERATION_DDL)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def _placed(self, ids: DataFrame) -> DataFrame:
        return ids.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.n_buckets)).cast("int"))

    def _bits(self, value: Column) -> Column:
        """Places of an id's bits in its bucket's filter."""
        size = max(64, self.bucket_ids * self.bits_per_id)
        return F.array(*[F.pmod(F.xxhash64(value, F.lit(i + 1)), F.lit(size)) for i in range(HASHES)])

    def _write(self, placed: DataFrame) -> None:
        rows = placed.repartition("bucket")  # a bucket is one file of a write
        rows.select("id", "tag", "bucket").write.mode("append").partitionBy("bucket").parquet(self._folder("ids"))
        bits = (placed.select("bucket", "tag", F.explode(self._bits(F.col("id"))).alias("at"))
                .groupBy("bucket", "tag", _word("at").alias("word")).agg(F.bit_or(_mask("at")).alias("bits")))
        bits.repartition("bucket").select("word", "bits", "tag", "bucket").write.mode("append").partitionBy("bucket").parquet(
            self._folder("bits"))

    def _read(self, kind: str, columns: str, buckets: list[int] | None) -> DataFrame | None:
        """The rows of some buckets (None: of all); other buckets are not even listed. None if nothing is there."""
        from papyra.sources.sinks import read_reader
        folder = self._folder(kind)
        reader = self.spark.read.schema(f"{columns}, tag string, bucket int").option("basePath", folder)
        if buckets is None or len(buckets) > MANY:
            found = read_reader(reader, folder)
            return found if found is None or buckets is None else found.where(F.col("bucket").isin(buckets))
        return read_reader(reader, f"{folder}/bucket={{{','.join(map(str, buckets))}}}") if buckets else None


def _buckets(placed: DataFrame) -> list[int]:
    """Buckets of some ids: at most as many as the index has."""
    return sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())


def _word(at: str) -> Column:
    return F.floor(F.col(at) / 64).cast("int")


def _mask(at: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod({at}, 64) as int))")
