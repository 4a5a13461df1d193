"""The id index and committed writes."""

import os

import pytest
from pyspark.sql import functions as F

from papyra.operators import idindex
from papyra.operators.idindex import IdIndex
from papyra.sources.commits import commit, commits, read_committed
from papyra.sources.sinks import store_new


def _ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "article_id string")


def _missing(index, spark, values, tag=None):
    return sorted(r["article_id"] for r in index.missing(_ids(spark, values), tag=tag).collect())


def test_new_ids_by_batches(spark, tmp_dir):
    stored = set()
    for n, batch in enumerate([["a", "b", "a", None], ["b", "c"], [], ["c", "d", "e"], [f"x{i}" for i in range(150)], ["x7", "a", "zz"]]):
        index = IdIndex(spark, f"{tmp_dir}/ids", bucket_ids=20)      # opened anew: the state is on disk
        want = sorted({v for v in batch if v is not None} - stored)
        assert _missing(index, spark, batch) == want
        index.add(_ids(spark, want), f"batch-{n}")
        stored |= set(want)
    index = IdIndex(spark, f"{tmp_dir}/ids", bucket_ids=20)
    assert index.n_ids == len(stored) and index.generation > 0 and index.n_buckets * 20 >= len(stored)
    assert _missing(index, spark, sorted(stored)) == []
    # a batch that is written again finds its own ids new
    assert _missing(index, spark, ["zz", "a"], tag="batch-5") == ["zz"]


def test_filter_lets_all_stored_ids_through_and_few_others(spark, tmp_dir, monkeypatch):
    index = IdIndex(spark, f"{tmp_dir}/ids", bucket_ids=500)
    index.add(spark.range(2000).select(F.col("id").cast("string").alias("article_id")), "t")
    opened = []
    read = IdIndex._read
    monkeypatch.setattr(IdIndex, "_read", lambda self, kind, columns, buckets: opened.append((kind, buckets)) or read(
        self, kind, columns, buckets))
    assert _missing(index, spark, ["5", "1999"]) == []
    opened.clear()
    assert _missing(index, spark, ["new-1"]) == ["new-1"]
    assert [k for k, _ in opened] in (["bits"], ["bits", "ids"]) and len(opened[0][1]) == 1
    opened.clear()
    others = [f"other-{i}" for i in range(400)]
    assert _missing(index, spark, others) == sorted(others)
    monkeypatch.setattr(idindex, "MANY", 1)                      # many buckets: read whole, filtered
    assert _missing(index, spark, [*others, "7", "1234"]) == sorted(others)


def _bytes(df):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())


def test_bytes_read_stay_flat(spark, tmp_dir, monkeypatch):
    """Twenty times as many stored ids: a batch opens as many buckets, of the same size."""
    read, took = IdIndex._read, []

    def counting(self, kind, columns, buckets):
        found = read(self, kind, columns, buckets)
        took.append((0, 0) if found is None else (_bytes(found), len(found.inputFiles())))
        return found

    sizes = []
    for n in (2_000, 40_000):
        index = IdIndex(spark, f"{tmp_dir}/ids-{n}", bucket_ids=200)
        ids = spark.range(n).select(F.concat(F.lit("article-"), F.col("id")).alias("article_id"))
        index.add(ids, "all")
        assert index.n_buckets == n // 200
        monkeypatch.setattr(IdIndex, "_read", counting)
        took.clear()
        assert _missing(index, spark, ["article-1", "article-17", "article-333", "n1", "n2", "n3"]) == ["n1", "n2", "n3"]
        n_bytes, n_files = map(sum, zip(*took, strict=True))
        assert 0 < n_files <= 2 * 6                              # filters and ids of at most six buckets
        sizes.append(n_bytes / n_files)
        monkeypatch.setattr(IdIndex, "_read", read)
    assert sizes[1] < 1.2 * sizes[0]


def test_store_new_and_half_written(spark, tmp_dir):
    rows = lambda *v: spark.createDataFrame([(i, a, x) for i, a, x in v], "idx long, article_id string, x string")
    path = f"{tmp_dir}/sink"
    assert store_new(rows((2, "a", "later"), (1, "a", "first"), (3, "b", "ü")), path, "one").count() == 2
    assert store_new(rows((9, "a", "again"), (4, "c", "new")), path, "two").count() == 1
    got = {r["article_id"]: (r["idx"], r["x"], r["tag"]) for r in read_committed(spark, path, "idx long, article_id string, x string").collect()}
    assert got == {"a": (1, "first", "one"), "b": (3, "ü", "one"), "c": (4, "new", "two")}
    # the same tag again: nothing is written twice
    assert store_new(rows((9, "a", "again"), (4, "c", "new")), path, "two").count() == 1
    assert len(commits(spark, path)) == 2
    # a writer that died before its commit left a folder: it is not read, and its tag is written again
    rows((7, "d", "half")).write.parquet(f"{path}/commit=three")
    schema = "idx long, article_id string, x string"
    assert read_committed(spark, path, schema).count() == 3
    assert store_new(rows((7, "d", "whole")), path, "three").first()["x"] == "whole"
    assert read_committed(spark, path, schema).count() == 4
    # two writers side by side that both took an id for new
    commit(rows((5, "a", "other")), path, "zz/four")
    assert read_committed(spark, path, schema).count() == 5
    assert read_committed(spark, path, schema, key="article_id").where("article_id = 'a'").first()["x"] == "first"


def test_nothing_stored(spark, tmp_dir):
    index = IdIndex(spark, f"{tmp_dir}/none")
    assert not index.exists and _missing(index, spark, ["a", None, "a"]) == ["a"]
    assert read_committed(spark, f"{tmp_dir}/none", "x string").count() == 0 and commits(spark, f"{tmp_dir}/none") == []


@pytest.mark.parametrize("earlier", [False, True])
def test_ingest_reads_its_own_buckets(spark, tmp_dir, earlier):
    """A sink from before the index gets one from its stored ids."""
    import json

    from papyra.streaming.ingest import ingest, ingested

    def land(n, ids):
        lines = [json.dumps({"idx": i, "title": "t", "article_id": f"id{i}", "text": ["body"]}) for i in ids]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_dir}/landing/{n}")

    def run(n):
        ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/sink", f"{tmp_dir}/ckpt", bucket_ids=10)
        assert sorted(r["idx"] for r in ingested(spark, f"{tmp_dir}/sink").collect()) == list(range(1, n + 1))

    if earlier:
        (spark.range(1, 26).select(F.col("id").alias("idx"), F.concat(F.lit("id"), "id").alias("article_id"), F.lit("x").alias("x"))
         .write.parquet(f"{tmp_dir}/sink/batch_id=before"))
    land(1, range(1, 31))
    run(30)
    land(2, range(20, 61))
    run(60)
    land(3, range(1, 61))
    run(60)
    assert IdIndex(spark, f"{tmp_dir}/sink-ids", 10).n_buckets > 1
