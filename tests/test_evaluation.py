"""Scoring and summaries."""

import math

from pyspark.sql import functions as F

from papyra.operators import evaluation as EV
from papyra.operators import lm


def test_masked_nll_edges(spark):
    tlp = spark.createDataFrame(
        [("m", 1, 0, -1.0, 0), ("m", 1, 1, -3.0, 0),      # prompt_len 0: masked == unmasked
         ("m", 2, 0, -1.0, 2), ("m", 2, 1, -3.0, 2)],     # prompt_len = all tokens: null
        "model string, id bigint, pos bigint, logprob double, prompt_len bigint")
    r = {x["id"]: x for x in lm.masked_nll(tlp).collect()}
    assert r[1]["nll"] == r[1]["nll_full"] == 2.0
    assert r[2]["nll"] is None and r[2]["nll_full"] == 2.0


def test_perplexity(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1.0,)], "l double")
    got = [r[0] for r in df.select(lm.perplexity(F.col("l"))).collect()]
    assert got[0] is None and got[1] is None and abs(got[2] - math.e) < 1e-12


def _emb(spark, words):
    rows = [(w, [float((i * 7 + j * j) % 5 - 2) for j in range(8)]) for i, w in enumerate(sorted(words))]
    return spark.createDataFrame(rows, "tok string, embedding array<float>")


def test_bertscore_identical_and_empty(spark):
    pairs = spark.createDataFrame([("m", 1, "alpha beta gamma", "alpha beta gamma"),
                                   ("m", 2, "", "alpha beta"),
                                   ("m", 3, "alpha", "zeta eta")],
                                  "model string, id bigint, prediction string, reference string")
    r = {x["id"]: x for x in EV.bertscore(pairs, _emb(spark, ["alpha", "beta", "gamma", "zeta"])).collect()}
    assert abs(r[1]["bert_p"] - 1) < 1e-9 and abs(r[1]["bert_r"] - 1) < 1e-9 and abs(r[1]["bert_f1"] - 1) < 1e-9
    assert r[2]["bert_p"] == r[2]["bert_r"] == r[2]["bert_f1"] == 0.0
    assert -1 <= r[3]["bert_p"] <= 1


def test_bertscore_matches_bruteforce(spark):
    import numpy as np
    texts = [("m", i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30)), " ".join(f"w{(i + j) % 23}" for j in range(40)))
             for i in range(1, 12)]
    pairs = spark.createDataFrame(texts, "model string, id bigint, prediction string, reference string")
    emb = _emb(spark, [f"w{i}" for i in range(36)])      # w36 has no vector: it matches nothing
    got = {x["id"]: x for x in EV.bertscore(pairs, emb).collect()}
    unit = {r["tok"]: np.array(r["embedding"], dtype=np.float64) for r in emb.collect()}
    unit = {t: v / np.linalg.norm(v) for t, v in unit.items()}

    def vecs(t):
        return np.array([unit.get(w, np.zeros(8)) for w in t.split()])
    for _, i, p, r in texts:
        sim = vecs(p) @ vecs(r).T
        bp, br = sim.max(1).mean(), sim.max(0).mean()
        assert abs(got[i]["bert_p"] - bp) < 1e-9 and abs(got[i]["bert_r"] - br) < 1e-9


def test_summary_nan_tie_absent(spark):
    res = spark.createDataFrame(
        [("a", 0, 1, float("nan"), 0.5, 0.5, 0.5), ("a", 0, 2, 2.0, 0.7, 0.5, 0.5),
         ("b", 1, 1, 1.0, 0.6, 0.5, 0.4), ("b", 1, 2, 3.0, 0.6, 0.5, 0.4)],
        "model string, model_pos bigint, id bigint, nll double, bert_p double, bert_r double, bert_f1 double")
    s = EV.summarise(res)
    rows = {r["model"]: r for r in s.collect()}
    assert set(rows) == {"a", "b"}                      # a declared model with no rows is absent
    assert rows["a"]["nll"] == 2.0                      # NaN skipped
    marks = {r["model"]: r for r in EV.best_marks(s).collect()}
    assert marks["a"]["best_nll"] == 1 and marks["b"]["best_nll"] == 1   # tie at 2.0: both marked
    assert marks["a"]["best_bert_r"] == 1 and marks["b"]["best_bert_r"] == 1
    assert marks["a"]["best_bert_f1"] == 1 and marks["b"]["best_bert_f1"] == 0
    cells = {r["model"]: r for r in EV.summary_cells(EV.best_marks(s)).collect()}
    assert cells["a"]["bert_f1_cell"] == "**0.5000**" and cells["b"]["bert_f1_cell"] == "0.4000"
    ranks = {r["model"]: r["sort_rank"] for r in EV.summary_sorted(s).collect()}
    assert ranks == {"a": 1, "b": 2}                    # bert_p ties at 0.6: ordered by model name


def test_grid_and_missing(spark):
    q = spark.createDataFrame([(1, "q1", "a1"), (2, "q2", "a2")], "id bigint, question string, answer string")
    out = spark.createDataFrame([("base", 1, "Q: q1\nA: x\ny")], "model string, id bigint, full_text string")
    g = EV.qna_grid(q, out)
    assert g.count() == 6
    assert g.where("model = 'base' AND id = 1").first()["prediction"] == "x"
    assert g.where("model = 'base' AND id = 1").first()["prompt"] == "Q: q1\nA:"
    assert EV.missing_predictions(q, out).count() == 5
    p = spark.createDataFrame([(0, "p0"), (1, "p1")], "prompt_pos bigint, prompt string")
    order = [(r["prompt_pos"], r["model"]) for r in EV.prompt_grid(p).collect()]
    assert order[:3] == [(0, "base"), (0, "FT_full"), (0, "FT-M1B")]
