"""PPM scores, quality and toxicity: brute force and held-out accuracy, and odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from papyra.llm import ppm
from papyra.llm.ppm import ppm_scores
from papyra.llm.quality import isotonic, quality_scores
from papyra.llm.toxicity import ToxicityModel, fold, toxicity_scores

from .helpers import SF, documents, no_docs, odd_docs


def held(i, n, r):
    return i is not None and zlib.crc32(str(i).encode()) % n == r


def brute_ppm(rows, order=ppm.ORDER):
    """(n_tokens, n_known, N, base, score) of each row, by walking a trie of dictionaries."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    count, trie = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    streams = [b"\xff" * order + b"".join(w + b" " for w in ws) + b"\xfe" for ws in words]
    for (i, _), ws, x in zip(rows, words, streams, strict=True):
        if not held(i, 10, 0):
            count.update(ws)
            count[b""] += 1
            for p in range(order, len(x)):
                for j in range(order + 1):
                    trie[j][x[p - j:p]][x[p]] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for ws, x in zip(words, streams, strict=True):
        tokens = [*ws, b""]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = 0.0
        for p in range(order, len(x)):
            excluded: set = set()
            for j in range(order, -1, -1):
                seen = trie[j].get(x[p - j:p])
                if not seen:
                    continue
                open_ = {s: c for s, c in seen.items() if s not in excluded}
                total = sum(open_.values())
                if x[p] in open_:
                    score += math.log10((2 * open_[x[p]] - 1) / (2 * total))
                    break
                if open_:
                    score += math.log10(len(open_) / (2 * total))
                excluded |= set(seen)
            else:
                score -= math.log10(256 - len(excluded))
        out.append((len(tokens), sum(count[w] > 0 for w in tokens), n, base, score))
    return out


def check_ppm(rows, got):
    assert len(rows) == len(got)
    want = sorted((str(i), held(i, 10, 0), *x) for (i, _), x in zip(rows, brute_ppm(rows), strict=True))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-6, atol=1e-9)


def test_ppm_brute_force(spark):
    docs = documents(spark).limit(60).cache()
    check_ppm([(r.doc_id, r.text) for r in docs.collect()], ppm_scores(docs).collect())


def test_ppm_odd_rows(spark):
    docs = odd_docs(spark).where("length(text) < 1000 or text is null")
    check_ppm([(r.doc_id, r.text) for r in docs.collect()], ppm_scores(docs).collect())
    assert ppm_scores(no_docs(spark)).count() == 0


def test_code_lengths_sum_to_one():
    """Over all symbols, the probabilities after one context add up to 1."""
    codes = np.array(sorted({(c << 8) | s for c in (0x616161616161, 0x626161616161) for s in (97, 98, 99)}), np.uint64)
    pairs = np.zeros(1 << 16, np.int64)
    for s in (97, 98, 99, 100):
        pairs[(0x61 << 8) | s] = 4
        pairs[(0x62 << 8) | s] = 2
    wanted = np.array([(0x616161616161 << 8) | s for s in range(256)], np.uint64)
    lengths = ppm.code_lengths(wanted, codes, np.array([2, 1, 3] * 2), pairs)
    assert abs((10 ** lengths).sum() - 1) < 1e-9


def test_quality_held_out(spark, sf01="/root/testdata/sf0.01"):
    docs, labels = (spark.read.parquet(f"{sf01}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id, 3, 1) for r in rows)
    assert sum(r.predicted == r.quality for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, None), (None, 1, 1), (9, 1, 0), (6, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality_scores(odd_docs(spark), labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_scores(odd_docs(spark), none).collect()} == {0.5}
    assert quality_scores(no_docs(spark), labels).count() == 0


def test_isotonic():
    x, y = isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert y.tolist() == [0, 0.5, 1] and x[1] == 1.5


def test_toxicity_held_out(spark, sf01="/root/testdata/sf0.01"):
    docs, labels = (spark.read.parquet(f"{sf01}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows if r.held_out) >= 0.93 * sum(r.held_out for r in rows)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity_scores(odd_docs(spark), labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity_scores(no_docs(spark), labels).count() == 0


def test_fold():
    assert fold("A M0rоn, L0SER!! 2024") == " a moron loser 2024 "
    assert fold(None) == fold("") == " "


def test_exception_phrases():
    model = ToxicityModel({" trash ": 3.0, " mor": 2.0})
    a = model.automaton()
    assert model.features("put it in the trash can", a)[1] == 0
    assert model.features("Tr4sh moron can", a)[1] == 5
    assert model.features("tumor", a)[1] == 0


def test_accepted_rows_are_those_predicted(spark):
    from papyra.llm.quality import accepted, learn_from_texts
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.unionByName(docs.limit(1).selectExpr("null as doc_id", "null as text", "lang", "source", "n_chars"))
    model = learn_from_texts(rows, labels)
    got = sorted((r["doc_id"] for r in accepted(rows, model).collect()), key=str)
    want = quality_scores(docs, labels).where("predicted = 1").collect()
    assert [i for i in got if i is not None] == sorted((r["doc_id"] for r in want), key=str) and len(want) < docs.count()
    assert accepted(rows.where("false"), model).count() == 0 and accepted(rows, model).schema == rows.schema
