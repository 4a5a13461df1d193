"""Language identification: n-gram counts against a plain loop, held-out accuracy, wrong labels, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from papyra.llm import langid
from papyra.llm.langid import gram_counts, language_ids
from papyra.llm.queries import QUERIES

from .helpers import LONG, SF, documents, no_docs, odd_docs

MIX = [2654435761, 2246822519, 3266489917, 668265263]


def brute_counts(text: bytes) -> np.ndarray:
    out = np.zeros(langid.DIM)
    s = b"\0\0" + bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 0 for c in text) + b"\0\0"
    for i in range(len(s)):
        for n in range(1, langid.ORDERS + 1):
            g = s[i:i + n]
            if len(g) < n or b"\0\0" in g or (n == 1 and g == b"\0"):
                continue
            code = int.from_bytes(g, "little")
            out[(code * MIX[n - 1] % 2 ** 32) >> (32 - langid.BITS)] += 1
    return out


def test_counts_equal_a_plain_loop(monkeypatch):
    texts = ["Hello, World 12 x", "", "ÀÉ  ñandú\n\n¿qué?", "a", " ", "zz" * 300, "\x00\x01", "end"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    want = np.array([brute_counts(r) for r in raw])
    for piece in (1 << 20, 7, 1):  # pieces of a long text count the same
        monkeypatch.setattr(langid, "PIECE", piece)
        got = gram_counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
        assert np.array_equal(got, want)


def test_query_on_held_out_rows(spark):
    got = QUERIES["op13_language_id"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(documents(spark).select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents(spark).count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 20


def test_wrong_labels_form_no_centroid(spark):
    words = {"aa": "the and of with from this that other", "bb": "und der das nicht mit auch eine sich"}
    rows = []
    for i in range(400):
        true = "aa" if i % 2 else "bb"
        label = true if i % 10 else ("bb" if true == "aa" else "aa")
        w = words[true].split()
        rows.append((i, " ".join(w[(i * 7 + j * (1 + i % 3)) % 8] for j in range(12)), label, true))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    got = language_ids(docs).join(docs.select("doc_id", "truth"), "doc_id")
    assert got.where("lang_pred <> truth").count() == 0


def test_rejection_flags_far_texts(spark):
    rows = [(i, " ".join(f"word{c} sample text number" for c in "abcdefgh"[i % 5:]), "en") for i in range(200)]
    rows += [(1000, "щука плавает в реке ночью тихо", None)]
    got = {r["doc_id"]: r for r in language_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000]["rejected"] and not got[3]["rejected"]
    assert got[1000]["lang_pred"] == "en"  # a learned language all the same


def test_odd_rows(spark):
    got = language_ids(odd_docs(spark).withColumn("score", F.lit("x")).withColumn("key", F.lit(1)))
    rows = got.collect()
    assert len(rows) == odd_docs(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (3, 4, 5):  # null, empty, blank
        assert [(r["lang_pred"], r["score"]) for r in by[i]] == [("und", 0.0)]
    assert len(by[2]) == 2 and len({(r["lang_pred"], r["score"]) for r in by[2]}) == 1
    assert by[6][0]["lang_pred"] == "en" and not any(r["held_out"] for r in by[None])


def test_no_rows_and_nothing_to_learn(spark):
    assert language_ids(no_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, "some words", None), (2, LONG, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_ids(blank).collect()} == {("und", 0.0)}
    only_blank = spark.createDataFrame([(1, None, "en"), (4, "12 34", "en"), (5, "words", None)],
                                       "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_ids(only_blank).collect()} <= {"und", "en"}
