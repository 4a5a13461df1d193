"""Lookups by blocks, joins with heavy keys, selection of the k-th key, counted n-grams."""

import math

import pytest
from pyspark.sql import functions as F

from papyra.operators import dataset as D
from papyra.operators import lm
from papyra.operators.blocks import heavy_join
from papyra.operators.ranking import kth_key


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_blocks", [None, 1, 7])
def test_tokenize_by_blocks(spark, n_blocks):
    rows = [(i, f"s{i % 3}", " ".join(f"w{(i * j) % 41}" for j in range(i % 9))) for i in range(120)]
    rows += [(5, "twice", "w1 w2 w1"), (5, "twice", "w1 w2 w1"), (None, "no id", "w3 unknown"), (200, None, None), (201, "e", "")]
    samples = spark.createDataFrame(rows, "idx bigint, tag string, x string")
    vocab = spark.createDataFrame([(f"w{i}", 1, i) for i in range(40)], "tok string, cnt bigint, id bigint")
    got = D.tokenize(samples, vocab, n_blocks=n_blocks)
    assert got.columns == ["idx", "tag", "input_ids"]
    want = [(i, t, None if x is None else [int(w[1:]) if w in {f"w{k}" for k in range(40)} else D.UNK_ID for w in x.split()])
            for i, t, x in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert D.tokenize(samples.where("false"), vocab, n_blocks=n_blocks).count() == 0


def test_token_positions_are_not_shuffled(spark):
    """A block shuffles its rows and each distinct token once, however often the token occurs."""
    samples = spark.range(2000).select(F.col("id").alias("idx"), F.lit("the same the word the").alias("x"))
    vocab = spark.createDataFrame([("the", 5, 0), ("same", 2, 1)], "tok string, cnt bigint, id bigint")
    got = D.tokenize(samples, vocab, n_blocks=4)
    assert "posexplode" not in _plan(got) and "collect_list" not in _plan(got)
    assert [r["input_ids"] for r in got.limit(1).collect()] == [[0, 1, 0, D.UNK_ID, 0]]


def test_heavy_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                    F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 7)], "k string, v bigint"))
    right = left.select("k").distinct().where("k <> '3'").withColumn("w", F.length("k"))
    got = heavy_join(left, right, ["k"], share=20)
    want = left.join(right, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2999
    assert heavy_join(left.where("false"), right, ["k"]).count() == 0


def test_kth_key(spark):
    df = spark.range(4000).select(F.md5(F.col("id").cast("string")).alias("h"), "id")
    df = df.unionByName(df.where("id < 50").withColumn("id", F.col("id") + 10_000))     # equal keys, other ids
    order = sorted((r["h"], r["id"]) for r in df.collect())
    for k in (0, 1, 2025, 4049):
        for few, step in ((10_000, 3), (5, 1), (1, 2), (0, 3)):
            assert kth_key(df, "h", "id", k, few=few, step=step) == order[k]
    assert kth_key(df, "h", "id", lambda n: n // 2) == order[len(order) // 2]
    with pytest.raises(IndexError):
        kth_key(df, "h", "id", 4050)


def test_split_sizes_write_nothing(spark, monkeypatch):
    import papyra.session
    monkeypatch.setattr(papyra.session, "materialize", lambda *a: pytest.fail("written"))
    samples = spark.range(57).select(F.col("id").alias("idx"))
    assert {r["split"]: r["n"] for r in D.split_sizes(samples).collect()} == {"train": 51, "eval": 6}
    assert D.split_boundary(samples)
    with pytest.raises(ValueError):
        D.split_sizes(spark.range(1))


def test_counted_nll_equals_the_sum_over_positions(spark):
    docs = spark.createDataFrame([("a a b",), ("c",)], "text string")
    train = spark.createDataFrame([("a b a b",)], "x string")
    m = lm.fit(docs, train)
    qna = spark.createDataFrame([(1, "a a a", "b zz"), (2, None, None), (3, "c", "")], "id bigint, question string, answer string")
    want = {(r["model"], r["id"]): r for r in lm.masked_nll(lm.token_logprobs(m, qna)).collect()}
    got = {(r["model"], r["id"]): r for r in lm.qna_nll(m, qna).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    for k, r in got.items():
        assert r["n_answer_tokens"] == want[k]["n_answer_tokens"]
        for c in ("nll", "nll_full"):
            assert (r[c] is None) == (want[k][c] is None) and (r[c] is None or math.isclose(r[c], want[k][c]))
    total = {r["model"]: r for r in lm.corpus_nll(m, train, "x").collect()}
    single = {r["model"]: r for r in lm.text_nll(m, train.withColumn("i", F.lit(1)), ["i"], "x").collect()}
    assert all(math.isclose(total[k]["nll"], single[k]["nll"]) and total[k]["n_tokens"] == 4 for k in total)


def test_nll_by_group(spark):
    docs = spark.createDataFrame([("x", "a a b"), ("y", "a c"), (None, "a"), ("z", "")], "lang string, text string")
    got = {r["lang"]: (r["n_tokens"], r["nll"]) for r in lm.nll_by_group(docs, "lang").collect()}
    p = {"a": 5 / 10, "b": 2 / 10, "c": 2 / 10}                  # 6 tokens, 3 kinds and one more
    assert got["x"][0] == 3 and math.isclose(got["x"][1], -(2 * math.log(p["a"]) + math.log(p["b"])) / 3)
    assert math.isclose(got["y"][1], -(math.log(p["a"]) + math.log(p["c"])) / 2)
    assert math.isclose(got[None][1], -math.log(p["a"])) and "z" not in got
