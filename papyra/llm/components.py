"""Connected components of a table of links: by alternating large-star and small-star rounds, or of few links by one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

FEW = 1 << 17  # links that one task joins at once (2 MB); of more, every round is a few shuffles


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b")))


def few_components(links: DataFrame) -> DataFrame:
    """``components`` of at most FEW links (a, b) of longs, without a shuffle for each round."""
    def run(batches):
        held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        a, b = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        a, b = a[a != b], b[a != b]
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[:len(a)], at[len(a):]
        root = np.arange(len(nodes))
        while (root[u] != root[v]).any():
            least = np.minimum(root[u], root[v])
            np.minimum.at(root, np.concatenate([root[u], root[v]]), np.concatenate([least, least]))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    return links.select("a", "b").repartition(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link in ``links`` (a, b); the root is the smallest node reachable.

    Each round costs a few shuffles of the links, and the number of rounds grows with the logarithm of the number of
    nodes. Every round is stored, so a lost executor repeats one round at most.
    """
    edges = links.where("a <> b").select("a", "b").distinct()
    mark = None
    for _ in range(max_rounds):
        edges = stage(_small_star(_large_star(edges)).where("a <> b").distinct(), "star")
        seen = edges.agg(F.count("a").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == (seen["n"], seen["x"]):
            break
        mark = (seen["n"], seen["x"])
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
