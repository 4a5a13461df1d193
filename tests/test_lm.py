"""N-gram LM variants against a plain-Python brute force on a small fixture."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from papyra.operators import lm

DOCS = ["The cat sat on the mat.", "A dog sat, the dog ran!", "Émile et le chat", ""]
TRAIN = ["the cat ran", "the dog sat on the cat", "zzz"]
SCORE = [(1, "the cat sat"), (2, "unseen words here"), (3, "")]


def toks(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute():
    base = Counter(w for d in DOCS for w in toks(d))
    n_doc, v_doc = sum(base.values()), len(base) + 1
    bi = Counter()
    for d in TRAIN:
        t = toks(d)
        for p, w in zip(["<s>"] + t[:-1], t):
            bi[(p, w)] += 1
    uni, prev = Counter(), Counter()
    for (p, w), c in bi.items():
        uni[w] += c
        prev[p] += c
    n_tr, v_tr = sum(uni.values()), len(uni) + 1
    out = {}
    for i, text in SCORE:
        t = toks(text)
        rows = {"base": [], "FT-M1B": [], "FT_full": []}
        for p, w in zip(["<s>"] + t[:-1], t):
            pb = (base[w] + 1) / (n_doc + v_doc)
            rows["base"].append(-math.log(pb))
            rows["FT-M1B"].append(-math.log(0.5 * (uni[w] + 1) / (n_tr + v_tr) + 0.5 * pb))
            rows["FT_full"].append(-math.log(0.5 * (bi[(p, w)] + 1) / (prev[p] + v_tr) + 0.5 * pb))
        for m, v in rows.items():
            out[(m, i)] = (len(v), sum(v) / len(v) if v else None)
    return out


def test_ngram_variants_match_bruteforce(spark):
    docs = spark.createDataFrame([(d,) for d in DOCS], "text string")
    train = spark.createDataFrame([(d,) for d in TRAIN], "x string")
    m = lm.fit(docs, train)
    s = spark.createDataFrame(SCORE, "item_id bigint, text string")
    got = {(r["model"], r["item_id"]): (r["n_tokens"], r["nll"]) for r in
           lm.text_nll(m, s, ["item_id"], "text").collect()}
    exp = brute()
    assert set(got) == set(exp)
    for k, (n, v) in exp.items():
        assert got[k][0] == n and (got[k][1] is None if v is None else abs(got[k][1] - v) < 1e-12), k


def test_token_logprobs_prompt_positions(spark):
    docs = spark.createDataFrame([(d,) for d in DOCS], "text string")
    train = spark.createDataFrame([(d,) for d in TRAIN], "x string")
    m = lm.fit(docs, train)
    q = spark.createDataFrame([(7, "the cat", "sat on")], "id bigint, question string, answer string")
    t = lm.token_logprobs(m, q).where(F.col("model") == "base").orderBy("pos").collect()
    # Q: the cat / A: sat on
    assert [r["pos"] for r in t] == [0, 1, 2, 3, 4, 5] and all(r["prompt_len"] == 4 for r in t)
    nll = lm.masked_nll(lm.token_logprobs(m, q)).where("model = 'base'").first()
    assert abs(nll["nll"] - (-(t[4]["logprob"] + t[5]["logprob"]) / 2)) < 1e-12
    empty = spark.createDataFrame([(8, "", None)], "id bigint, question string, answer string")
    nll = lm.masked_nll(lm.token_logprobs(m, empty)).where("model = 'base'").first()
    assert nll["nll"] is None and nll["n_answer_tokens"] == 0


def test_nll_scores_each_ngram_once(spark, monkeypatch):
    """The n-grams are looked up in one stored pass, for texts with and without keys, and ids may repeat."""
    calls = []
    real = lm.ngram_logprobs
    monkeypatch.setattr(lm, "ngram_logprobs", lambda m, g: calls.append(g.columns) or real(m, g))
    m = lm.fit(spark.createDataFrame([(d,) for d in DOCS], "text string"), spark.createDataFrame([(d,) for d in TRAIN], "x string"))
    twice = spark.createDataFrame([(1, "the cat the cat sat"), (1, "the dog"), (None, "the cat")], "item_id bigint, text string")
    counted = lm.counted_ngrams(twice, ["item_id"], F.split("text", " "))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    keyed = {r["item_id"]: r for r in lm.nll_of_counts(m, counted, ["item_id"]).where("model = 'FT_full'").collect()}
    assert {k: r["n_tokens"] for k, r in keyed.items()} == {1: 7, None: 2}
    total = lm.corpus_nll(m, twice, "text").where("model = 'FT_full'").first()
    assert total["n_tokens"] == 9 and abs(total["nll"] - sum(r["nll"] * r["n_tokens"] for r in keyed.values()) / 9) < 1e-12
    assert calls == [["prev", "tok", "n"], ["prev", "tok", "n", "n_answer"]]
