"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees are grown on a bounded sample (``SAMPLE`` vectors, picked by a hash of the vector); every row is then put into
one leaf of each tree. A query walks all trees through one shared priority queue, closest margins first, until it has
``n_leaves`` leaves; the members of those leaves are scored exactly and the best are merged over the leaves.

Equal vectors form one class that is indexed and searched once, whatever its size; a class carries its k + 1 smallest
ids, as no other member can be among the k nearest. Vectors that are null, zero, or hold null or non-finite components
take no part, nor do vectors of another length than the most common one. An id with several rows counts once (its
smallest vector).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SAMPLE = 20_000  # vectors that the trees are grown on; their classes are all indexed
LEAF = 48  # sample vectors in a leaf at most
CHUNK = 20_000  # members of a leaf that are scored in one group


@dataclass
class Forest:
    normals: np.ndarray  # a row per inner node
    offsets: np.ndarray
    children: np.ndarray  # (inner nodes, 2): index of an inner node, or -1 - leaf
    roots: np.ndarray
    n_leaves: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, np.int64)
            while (live := np.flatnonzero(at >= 0)).size:
                node = at[live]
                side = np.einsum("ij,ij->i", x[live], self.normals[node]) + self.offsets[node] > 0
                at[live] = self.children[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, n_leaves: int) -> list[int]:
        """Leaves of one unit vector, by the shared queue of all trees."""
        margins = self.normals @ q + self.offsets
        queue = [(-np.inf, int(r)) for r in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < n_leaves:
            bound, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                near = int(m > 0)
                heapq.heappush(queue, (max(bound, abs(m)), int(self.children[node, 1 - near])))
                node = int(self.children[node, near])
            found.append(-1 - node)
        return found


def grow(sample: np.ndarray, n_trees: int, leaf: int = LEAF, seed: int = 5) -> Forest:
    """Trees over unit vectors: each split lies halfway between two random members."""
    rng = np.random.default_rng(seed)
    normals: list[np.ndarray] = []
    offsets: list[float] = []
    children: list[list[int]] = []
    n_leaves = 0
    roots = []
    for _ in range(n_trees):
        stack: list[tuple[np.ndarray, tuple[int, int] | None]] = [(np.arange(len(sample)), None)]
        while stack:
            rows, where = stack.pop()
            node = None
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    normal = a - b
                    size = np.linalg.norm(normal)
                    if size < 1e-12:
                        continue
                    normal = normal / size
                    offset = -float(normal @ (a + b)) / 2
                    side = sample[rows] @ normal + offset > 0
                    if 0.05 < side.mean() < 0.95:
                        node = len(normals)
                        normals.append(normal)
                        offsets.append(offset)
                        children.append([0, 0])
                        stack += [(rows[~side], (node, 0)), (rows[side], (node, 1))]
                        break
            if node is None:
                node = -1 - n_leaves
                n_leaves += 1
            if where is None:
                roots.append(node)
            else:
                children[where[0]][where[1]] = node
    d = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, d), np.array(offsets), np.array(children, np.int64).reshape(-1, 2),
                  np.array(roots), n_leaves)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, one per id."""
    good = (F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists("v", lambda x: x != 0))
    found = (rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
             .where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
             .groupBy("id").agg(F.min("v").alias("v")))
    return found


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", query_every: int = 50, k: int = 5,
            n_trees: int = 24, n_leaves: int = 400) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each id divisible by ``query_every``."""
    found = stage(valid_vectors(rows, key, vector), "vectors")
    sizes = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return rows.sparkSession.createDataFrame([], out)
    d = sizes[0]["d"]
    found = found.where(F.size("v") == d)
    by_vector = Window.partitionBy("v").orderBy("id")
    classes = stage(found.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
                    .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                    .select(F.col("ids")[0].alias("c"), "v", "ids"), "vector-classes")
    n = classes.count()
    share = min(1.0, SAMPLE / n)
    picked = classes.where(F.pmod(F.xxhash64("c"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toArrow()
    sample = _unit(_matrix(picked.column(0).combine_chunks()))
    forest = grow(sample, n_trees)
    salts = max(1, round(LEAF * n / max(1, len(sample)) / CHUNK))  # groups that a leaf of many rows is split into
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # at most 2 * SAMPLE / LEAF inner nodes a tree

    def place(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                leaves = shared.value.leaves(_unit(_matrix(part.column(1))))
                at = np.repeat(np.arange(len(leaves)), leaves.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(leaves.ravel()), *(c.take(pa.array(at)) for c in part.columns)],
                                                 ["leaf", "c", "v"])

    def walk(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(1))) if batch.num_rows else np.zeros((0, d))
            lists = [shared.value.search(q, n_leaves) for q in x]
            at = np.repeat(np.arange(len(lists)), [len(a) for a in lists])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([b for a in lists for b in a], np.int32)),
                 *(c.take(pa.array(at)) for c in batch.columns)], ["leaf", "c", "v"])

    members = (classes.select("c", "v").mapInArrow(place, f"leaf int, c long, v {dict(classes.dtypes)['v']}")
               .withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(salts)).cast("int")))
    queries = found.where(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    asked = stage(queries.join(classes, F.col("qv") == F.col("v")).select("query_id", "c"), "queries")
    seeking = (classes.join(asked.select("c").distinct(), "c", "left_semi").select("c", "v")
               .mapInArrow(walk, f"leaf int, c long, v {dict(classes.dtypes)['v']}")
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        qs, q = left["c"].to_numpy(), _matrix(left["v"].combine_chunks())
        cs, c = right["c"].to_numpy(), _matrix(right["v"].combine_chunks())
        order = np.argsort(cs, kind="stable")
        cs, c = cs[order], c[order]
        norm_c = np.sqrt(np.einsum("ij,ij->i", c, c))
        got: list[np.ndarray] = []
        for lo in range(0, len(qs), 256):
            part = q[lo:lo + 256]
            cos = np.einsum("ij,kj->ik", part, c) / (np.sqrt(np.einsum("ij,ij->i", part, part))[:, None] * norm_c)
            best = np.argsort(-cos, axis=1, kind="stable")[:, :k + 1]  # equal scores: smaller id first
            got.append(np.column_stack([np.repeat(qs[lo:lo + 256], best.shape[1]).astype(float), best.ravel(),
                                        np.take_along_axis(cos, best, 1).ravel()]))
        rows = np.concatenate(got)
        at = rows[:, 1].astype(np.int64)
        return pa.table({"q": pa.array(np.repeat(qs, min(k + 1, len(cs)))), "c": pa.array(cs[at]),
                         "score": pa.array(rows[:, 2])})

    scored = (seeking.groupBy("leaf", "salt").cogroup(members.groupBy("leaf", "salt"))
              .applyInArrow(score, "q long, c long, score double"))
    pairs = scored.groupBy("q", "c").agg(F.max("score").alias("score"))
    best = (pairs.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c")))
            .where(F.col("n") <= k + 1).select("q", "c", "score"))
    named = best.join(classes.select("c", "ids"), "c").groupBy("q").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    listed = (asked.join(named, asked["c"] == named["q"]).select("query_id", F.explode("near").alias("x"))
              .select("query_id", "x.score", F.explode("x.ids").alias("vec_id")).where("vec_id <> query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (listed.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
