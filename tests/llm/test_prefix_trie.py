"""Conversation trie against a trie of dictionaries: rebuilt conversations, deep sequences, copies, odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from papyra.llm import prefix_trie
from papyra.llm.prefix_trie import conversation_trie, ends_digest, numbered_turns
from papyra.llm.queries import QUERIES

from .helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tie(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    convs = {c: [(r[3], r[4]) for r in sorted(ts)] for c, ts in convs.items()}
    members = {}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        full[c] = tuple(convs.get(c - base, [])[:h] + own[h:])
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        leaf = path not in kids
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + leaf
            saved[path[:d]] = saved.get(path[:d], 0) + own
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest())
                  for p, m in members.items())


def rows_of(df):
    return sorted(tuple(-1 if r[c] is None and c == "parent_conv_id" else r[c] for c in COLUMNS) for r in df.collect())


def random_rows(seed, n, most, kinds=2, step=1):
    rng = random.Random(seed)
    return [(i * step, t, rng.choice(["user", "bot"][:kinds]), "ab"[:rng.randrange(3)])
            for i in range(n) for t in range(rng.randrange(1, most + 1))]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op11_prefix_trie"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("seed,n,most,kinds,step", [(1, 120, 9, 1, 1), (2, 40, 70, 1, 37), (3, 250, 3, 2, 1), (4, 30, 1, 2, 50)])
def test_random_conversations(spark, seed, n, most, kinds, step):
    rows = random_rows(seed, n, most, kinds, step)
    assert rows_of(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)  # several runs of ids in a digest
    rows = [(7, t, "user", "x" * (t % 3)) for t in range(700)]
    rows += [(1000 + c, t, "user", "same") for c in range(300) for t in range(8)]
    rows += [(5000 + c, t, "user", f"{c}") for c in range(200) for t in range(7)]  # a root of many children
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(conversation_trie(df)) == brute(rows)
    # the long conversation is numbered in several pieces, the numbers of a piece have no gap
    pieces = numbered_turns(df.repartition(4)).where("conv = 7").groupBy("piece").agg(F.count("at").alias("n"), F.max("at").alias("m"))
    found = pieces.collect()
    assert len(found) > 1 and all(r["n"] == r["m"] for r in found)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, "user", "b"), (1, 3, "user", None), (1, 3, "user", None),
            (1, 2, None, "x"), (100, 1, "user", "ü\U0001F600"), (100, 2, "user", "z"), (101, 5, "user", "z"), (104, 0, "user", "q"),
            (-5, 1, "user", "b"), (-205, 1, "user", "b"), (-200, 9, "user", "base"), (305, 1, "ab", "c"), (306, 1, "a", "bc"),
            (2 ** 40, 1, "user", "word " * 50_000)]
    rows += [(100 + c, t, "user", "t") for c in range(10, 60) for t in range(c % 4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as at", "'x' as symbol", "3 as depth")
    got = rows_of(conversation_trie(df))
    assert got == brute(rows)
    turnless = [c for c in {r[0] for r in rows if r[0] is not None}
                if zlib.crc32(str(c).encode()) % 6 >= sum(r[0] == c for r in rows) and c % 100 and c - c % 100 not in {r[0] for r in rows}]
    assert turnless  # some conversation has no turn left and is still a member of the root
    assert conversation_trie(df.where("false")).count() == 0
    assert conversation_trie(df.where("conv_id is null")).count() == 0


def test_only_turnless_conversations(spark):
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(alone, 1, "user", "gone")]
    got = rows_of(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 1 and got[0][5] == 1


def test_digest_of_runs(spark):
    ids = [-20_000, -8192, -1, 0, 5, 8191, 8192, 30_000]
    df = spark.createDataFrame([(b"a", i) for i in reversed(ids)] + [(b"b", 3)], "ends binary, conv long")
    got = {bytes(r["ends"]): r["ends_sha256"] for r in ends_digest(df).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"3").hexdigest()}
