"""Hard negatives by anchor spanning-tree bounds.

Anchors are the rows whose id is divisible by ``anchor_every``; the score of a row is its inner product with the anchor
over components floor(scale * x). An anchor's positives are its best rows of the same label; for each positive the
hardest negatives are the best rows of another label whose score lies between ``low`` and ``high`` percent of the
positive's (higher scores first, ties by smaller id).

Anchors are grouped into blocks of at most ``BLOCK`` around pivots, and the anchors of a block are linked by a minimum
spanning tree. A row whose score at the parent lies in [lo, hi] scores at the child between lo - d|x| and hi + d|x| (d:
the length of the edge, |x|: the row's norm). The tree is walked from its root, where all rows are scored; at every
other anchor only rows whose bounds reach into a window that is still open are scored again, the others hand their
bounds on. Bounds leave out only rows that cannot be in the result, so the result is exact.

All anchors meet all rows (a stated query set), block by chunk: a task holds one block and one chunk of about ``CHUNK``
rows, dealt by a hash of the id, so that no label, however frequent, gathers in a task. Every task returns its best rows
of each window, and the best of those are kept.

Rows with a null id, label or vector or with a null or non-finite component take no part; an id with several rows
counts once (its smallest label, then vector). A shorter vector counts as padded with zeros. Components beyond 2^31
after scaling count as 2^31; scores that do not fit a long wrap around.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BLOCK = 2048  # anchors of a block at most (about; cells are cut by a hash)
CHUNK = 4096  # rows of a chunk, on average
PIVOTS = 512  # at most this many anchors serve as centres of blocks
EXACT = 2.0 ** 53


def quantised(column: pa.ChunkedArray | pa.Array, scale: float, width: int = 0) -> np.ndarray:
    """Rows of floor(scale * x) as whole float64 numbers, padded with zeros to one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    flat = np.floor(flat * scale).clip(-2.0 ** 31, 2.0 ** 31)
    width = max(width, int(sizes.max()) if len(sizes) else 0)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def valid_rows(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the rows that take part, one per id."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    named = rows.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return (named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
            .groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"))


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree from the point nearest to the mean: (rows in depth-first order, position of each one's
    parent in that order, length of the edge to it); the root has parent -1."""
    n = len(points)
    root = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    parent, dist = np.full(n, root), np.sqrt(((points - points[root]) ** 2).sum(axis=1))
    children: list[list[int]] = [[] for _ in range(n)]
    open_ = np.ones(n, bool)
    open_[root] = False
    for _ in range(n - 1):
        i = int(np.where(open_, dist, np.inf).argmin())
        open_[i] = False
        children[parent[i]].append(i)
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        nearer = open_ & (d < dist)
        parent[nearer], dist[nearer] = i, d[nearer]
    dist[root] = 0.0
    order, stack = [], [root]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += children[i]
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    above = at[parent[order]]
    above[0] = -1
    return np.array(order), above, dist[order]


class Walk:
    """Scores of a chunk of rows at the anchors of a tree, in its depth-first order."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, rows.shape[1])
        self.rows = rows if most < EXACT else rows.astype(np.int64)
        self.anchors = anchors if most < EXACT else anchors.astype(np.int64)
        self.norm = np.sqrt((rows ** 2).sum(axis=1)) * (1 + 1e-9)
        self.parent, self.edge = parent, edge
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.left = np.bincount(parent[parent >= 0], minlength=len(parent))  # children still to come
        self.rescored = 0

    def reach(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all rows at anchor i, from its parent's; the root has none."""
        p = int(self.parent[i])
        if p < 0:
            return np.full(len(self.rows), -np.inf), np.full(len(self.rows), np.inf)
        lo, hi = self.bounds[p]
        self.left[p] -= 1
        if not self.left[p]:
            del self.bounds[p]
        slack = self.edge[i] * (1 + 1e-9) * self.norm + 1e-6
        return lo - slack, hi + slack

    def score(self, i: int, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted rows (positions) at anchor i; bounds of all rows are kept for its children."""
        if 2 * len(wanted) > len(self.rows):
            found = (self.rows @ self.anchors[i])[wanted]
        else:
            found = self.rows[wanted] @ self.anchors[i]
        self.rescored += len(wanted)
        if self.left[i]:
            lo, hi = lo.copy(), hi.copy()
            lo[wanted] = hi[wanted] = found
            self.bounds[i] = lo, hi
        return found


def _walks(anchors: pa.Table, rows: pa.Table, scale: float):
    """(anchors in tree order, row ids and labels, walk); rows are sorted by id."""
    anchors, rows = anchors.sort_by("n"), rows.sort_by("id")
    a, x = quantised(anchors["v"], scale), quantised(rows["v"], scale)
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, x))
    walk = Walk(x, a, anchors["parent"].to_numpy(), anchors["edge"].to_numpy())
    return anchors, rows["id"].to_numpy(), rows["label"].to_numpy(), walk


def best_positives(anchors: pa.Table, rows: pa.Table, n_pos: int, scale: float) -> pa.Table:
    """The ``n_pos`` best other rows of each anchor's label in a chunk: (anchor, id, score)."""
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if anchors.num_rows and rows.num_rows:
        anchors, ids, labels, walk = _walks(anchors, rows, scale)
        for i, (key, label) in enumerate(zip(anchors["id"].to_pylist(), anchors["label"].to_pylist(), strict=True)):
            lo, hi = walk.reach(i)
            mine = np.flatnonzero((labels == label) & (ids != key))
            # open window: from the least score that the n_pos best are sure to have
            least = np.partition(lo[mine], -n_pos)[-n_pos] if len(mine) > n_pos else -np.inf
            wanted = np.arange(len(ids)) if walk.parent[i] < 0 else mine[hi[mine] >= least]
            score = walk.score(i, lo, hi, wanted)
            if walk.parent[i] < 0:
                score, wanted = score[mine], mine
            top = np.lexsort((ids[wanted], -score))[:n_pos]
            got.append((np.full(len(top), key), ids[wanted[top]], score[top].astype(np.int64)))
    return _table(got, ("anchor", "id", "score"))


def best_negatives(anchors: pa.Table, rows: pa.Table, n_neg: int, scale: float, low: int, high: int) -> pa.Table:
    """For each positive of each anchor the ``n_neg`` best rows of a chunk in its window: (anchor, positive, id, score).

    ``anchors`` holds the positives (id, score) of each in ``near``.
    """
    got: list[tuple[np.ndarray, ...]] = []
    if anchors.num_rows and rows.num_rows:
        anchors, ids, labels, walk = _walks(anchors, rows, scale)
        for i, (key, label, near) in enumerate(zip(*(anchors[c].to_pylist() for c in ("id", "label", "near")), strict=True)):
            windows = [(p["id"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in near or []]
            windows = [w for w in windows if w[1] <= w[2]]
            lo, hi = walk.reach(i)
            if walk.parent[i] < 0:
                wanted = np.arange(len(ids))
            elif windows:
                least, most = min(w[1] for w in windows), max(w[2] for w in windows)
                wanted = np.flatnonzero((hi >= least) & (lo <= most) & (labels != label))
            else:
                wanted = np.zeros(0, np.int64)
            score = walk.score(i, lo, hi, wanted).astype(np.int64)
            other = labels[wanted] != label
            wanted, score = wanted[other], score[other]
            order = np.lexsort((ids[wanted], -score))
            wanted, score = wanted[order], score[order]
            for positive, least, most in windows:
                a = int(np.searchsorted(-score, -most, "left"))
                b = min(a + n_neg, int(np.searchsorted(-score, -least, "right")))
                if a < b:
                    got.append((np.full(b - a, key), np.full(b - a, positive), ids[wanted[a:b]], score[a:b]))
    return _table(got, ("anchor", "positive", "id", "score"))


def _table(parts: list, names: tuple) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table({name: pa.array(c.astype(np.int64)) for name, c in zip(names, columns, strict=True)})


def anchor_trees(anchors: DataFrame, scale: float, block_size: int = BLOCK) -> tuple[DataFrame, int]:
    """(block, n, parent, edge, id, label, v) of the anchors (id, label, v), and the number of blocks.

    Cells around at most ``PIVOTS`` anchors (picked by a hash of the id) are cut into blocks by another hash; the driver
    receives the pivots and one count per cell.
    """
    total = anchors.count()
    n_pivots = min(PIVOTS, math.ceil(total / block_size))
    if n_pivots <= 1:
        placed, n_blocks = anchors.withColumn("block", F.lit(0)), min(total, 1)
    else:
        pivots = anchors.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("v").toArrow()
        centres = quantised(pivots["v"], scale)

        def cell(batches):
            for batch in batches:
                x = quantised(batch.column(2), scale, centres.shape[1])
                c = np.pad(centres, ((0, 0), (0, x.shape[1] - centres.shape[1])))
                near = ((c ** 2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "cell"])

        kinds = ", ".join(f"{a} {b}" for a, b in anchors.dtypes)
        celled = stage(anchors.mapInArrow(cell, f"{kinds}, cell int"), "anchor-cells")
        first, table = 0, []
        for r in sorted(celled.groupBy("cell").count().collect(), key=lambda r: r["cell"]):  # at most PIVOTS rows
            cuts = math.ceil(r["count"] / block_size)
            table.append((r["cell"], first, cuts))
            first += cuts
        cuts = anchors.sparkSession.createDataFrame(table, "cell int, first int, cuts int")
        n_blocks = first
        placed = (celled.join(F.broadcast(cuts), "cell").withColumn(
            "block", (F.col("first") + F.pmod(F.xxhash64("id", F.lit("block")), F.col("cuts"))).cast("int"))
            .drop("cell", "first", "cuts"))

    def tree(part: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(quantised(part["v"], scale))
        part = part.take(pa.array(order))
        return pa.table({"block": part["block"], "n": pa.array(np.arange(len(order))), "parent": pa.array(parent),
                         "edge": pa.array(edge), "id": part["id"], "label": part["label"], "v": part["v"]})

    kinds = dict(anchors.dtypes)
    out = f"block int, n long, parent long, edge double, id long, label {kinds['label']}, v {kinds['v']}"
    return stage(placed.groupBy("block").applyInArrow(tree, out), "anchor-trees"), n_blocks


def hard_negatives(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   anchor_every: int = 100, n_pos: int = 5, n_neg: int = 5, low: int = 80, high: int = 100,
                   scale: float = 256.0, block_size: int = BLOCK, chunk_size: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1 within a positive."""
    found = stage(valid_rows(rows, key, vector, label), "vectors")
    trees, n_blocks = anchor_trees(found.where(F.col("id") % anchor_every == 0), scale, block_size)
    n_chunks = max(1, math.ceil(found.count() / chunk_size))
    of_chunk = F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(n_chunks)).cast("int")
    chunks = (found.withColumn("chunk", of_chunk)
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1)))))

    def meet(anchors: DataFrame, run, out: str) -> DataFrame:
        every = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
        return every.groupBy("block", "chunk").cogroup(chunks.groupBy("block", "chunk")).applyInArrow(run, out)

    def first(found: DataFrame, n: int, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= n)

    near = meet(trees, lambda a, x: best_positives(a, x, n_pos, scale), "anchor long, id long, score long")
    positives = stage(first(near, n_pos, "anchor"), "positives")
    listed = positives.groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("near"))
    asked = trees.join(listed.withColumnRenamed("anchor", "id"), "id", "left")
    hard = meet(asked, lambda a, x: best_negatives(a, x, n_neg, scale, low, high),
                "anchor long, positive long, id long, score long")
    best = first(hard, n_neg, "anchor", "positive")
    scores = positives.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    return best.join(scores, ["anchor", "positive"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
