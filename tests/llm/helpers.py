"""Fixtures shared by the operator tests: odd rows and small readers."""

from __future__ import annotations

import hashlib

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
# nulls in any column, empty and blank texts, repeated rows, ties, a very long text
ODD = [(1, "one two three\nfour five six\nseven eight nine\nten eleven twelve", "en", "a"),
       (2, "one two three\nfour five six\nseven eight nine\nten eleven twelve", "en", "a"),
       (2, "one two three\nfour five six\nseven eight nine\nten eleven twelve", "en", "a"),
       (3, None, None, None), (4, "", "en", "b"), (5, " \n\t \n", "en", None), (None, "a lost line", "en", "b"),
       (6, LONG, "en", "a"), (7, "Ünïcode 日本語 \U0001F600 text\x00with nul", None, "c"), (8, "short", "en", "a"),
       (None, None, None, None)]


def odd_docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def shingles(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked_components(texts: dict) -> dict:
    """Smallest id reachable by Jaccard links of 0.75 and more, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
