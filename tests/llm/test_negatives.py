"""Hard negatives: brute force over all pairs, ties, blocks and chunks, bounds that leave rows out, odd rows."""

import math
import random

import numpy as np
import pytest

from papyra.llm import negatives
from papyra.llm.negatives import Walk, hard_negatives, spanning_tree
from papyra.llm.queries import QUERIES

from .helpers import SF

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, n_pos=5, n_neg=5):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        best[i] = min(best.get(i, (label, v)), (label, v))
    q = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a in (i for i in q if i % every == 0):
        score = {i: sum(x * y for x, y in zip(q[a][1], w, strict=False)) for i, (_, w) in q.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if q[i][0] == q[a][0]][:n_pos]:
            hard = [i for i in order if q[i][0] != q[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(hard[:n_neg])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def some_rows(n, seed, dim=6, labels=3, spread=1.0, groups=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i * 10, [float(np.float32(c + rng.gauss(0, spread))) for c in centres[i % groups]], rng.randrange(labels))
            for i in range(n)]


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    assert rows_of(QUERIES["op12_hard_negatives"](spark, SF)) == want and want


@pytest.mark.parametrize("block,chunk,spread", [(2048, 4096, 0.05), (5, 40, 0.05), (7, 30, 1.0)])
def test_blocks_and_chunks_change_nothing(spark, block, chunk, spread):
    rows = some_rows(300, 1, spread=spread)
    rows += [(7000 + i, rows[3][1], i % 2) for i in range(60)]  # many equal vectors: ties by id
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), block_size=block, chunk_size=chunk)
    assert rows_of(got) == brute(rows)


def test_bounds_leave_rows_out_and_stay_right():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (8, 12))
    anchors = np.floor(centres[np.arange(40) % 8] + rng.normal(0, 1, (40, 12)))
    rows = np.floor(centres[np.arange(400) % 8] + rng.normal(0, 1, (400, 12)))
    order, parent, edge = spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(parent[i] < i for i in range(1, 40))
    anchors = anchors[order]
    walk = Walk(rows, anchors, parent, edge)
    for i in range(40):
        exact = rows @ anchors[i]
        lo, hi = walk.reach(i)
        assert (lo <= exact).all() and (exact <= hi).all()
        wanted = np.arange(400) if i == 0 else np.flatnonzero(hi >= np.partition(lo, -5)[-5])
        assert set(np.argsort(-exact, kind="stable")[:5]) <= set(wanted) or i == 0
        assert (walk.score(i, lo, hi, wanted) == exact[wanted]).all()
    assert walk.rescored < 0.5 * 40 * 400 and not walk.bounds


def test_tree_is_of_least_length():
    points = np.floor(np.random.default_rng(5).normal(0, 50, (30, 4)))
    _, _, edge = spanning_tree(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    joined, total = {0}, 0.0
    while len(joined) < 30:
        d, j = min((far[i, j], j) for i in joined for j in range(30) if j not in joined)
        joined.add(j)
        total += d
    assert abs(edge.sum() - total) < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_rows(40, 2) + [(None, [1.0] * 6, 1), (100, None, 1), (5, [1.0, nan, 0.0, 0.0, 0.0, 0.0], 1), (6, [inf] * 6, 1),
                               (7, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (8, [1.0] * 6, None), (11, [], 1), (12, [0.5], 2),
                               (13, [0.0] * 6, 0), (200, [1.0] * 6, 2), (200, [1.0] * 6, 2), (300, [0.0] * 6, 1),
                               (400, [-1.0] * 6, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as block", "'x' as score", "3 as n")
    assert rows_of(hard_negatives(df)) == brute([r for r in rows])
    assert hard_negatives(df.where("false")).count() == 0
    assert hard_negatives(df.where("vec_id % 100 <> 0")).count() == 0


def test_scores_beyond_doubles_are_whole(spark):
    big = 2.0 ** 20
    rows = [(0, [big, 1.0, big], 1), (1, [big, 1 / 256, -big], 1), (2, [big, 2 / 256, -big], 2), (3, [big, 0.0, big], 2),
            (4, [1 / 256, big, 1 / 256], 1), (5, [1 / 256, big - 1, 2 / 256], 2)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert negatives.EXACT == 2 ** 53
