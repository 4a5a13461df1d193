"""Suffix-array dedup: remove every byte that lies in a string of 400 bytes which starts anywhere else as well.

Suffixes that cannot repeat are ruled out before any sorting. Every window of 400 bytes has an anchor: the smallest
hash of its 32-byte grams, so equal windows have equal anchors at equal distances. The windows of one anchor are cut
into pieces of up to ``WIDTH`` neighbouring starts, which all hold a common core of bytes. Pieces whose core occurs
once cannot repeat and stop there (counted over the corpus, remembered in a Bloom filter of fixed size). The other
pieces meet by core; in each group the suffixes to the right of the core, and the reversed ones to its left, are put
in order by deep-shallow sorting: multikey quicksort to depth ``SHALLOW``, then a blind trie for each group that is
still equal. The common prefixes of neighbours tell which windows are equal.

Cores that occur very often (``HOT``) are not grouped at all: their windows are counted one by one, by a 128-bit hash,
in an aggregate with a join back, which Spark can split. Texts that occur twice or more repeat wholly and are settled
by their digest; their content still counts for the others.

A null text is empty. Strings are judged on the input; texts shorter than the window keep every byte, and a repeat
within one text counts like any other. Rows are told apart by id and text digest, so repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stage, text_slices
from .jaccard import SHIFTS, Bitmap, bitmap

LENGTH = 400
GRAM = 32
WIDTH = 64
SHALLOW = 16
HOT = 512
SLICE = 1 << 20
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_TABLES = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES]


class _Hashes:
    """Hashes of any byte range of a slice, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        size = 1 << max(20, int(len(data) + 1).bit_length())
        power, self.inverse = _powers(_BASES[which], size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * power[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, first: _Hashes
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, q, lo, hi) of each piece: windows that start at lo..hi and have that anchor.

    ``q`` numbers the pieces of an anchor by the distance of the starts: ``anchor - start`` is in [q WIDTH, (q+1) WIDTH).
    """
    none = np.zeros(0, np.int64)
    reach = length - GRAM + 1
    if len(data) < length:
        return none, none, none, none, none
    grams = np.arange(len(data) - GRAM + 1)
    bits = np.uint64(max(20, len(data).bit_length()))
    low = (first.of(grams, grams + GRAM) >> bits << bits) | grams.astype(np.uint64)
    width = 1
    while 2 * width <= reach:  # sliding minimum by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(grams) - reach + 1], low[reach - width:len(grams) - width + 1])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    valid = np.zeros(len(data) + 1, np.int64)  # windows inside one text
    big = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][big], 1)
    np.add.at(valid, offsets[1:][big] - length + 1, -1)
    inside = np.cumsum(valid)[:len(anchor)] > 0
    anchor, start = anchor[inside], start[inside]
    if not len(start):
        return none, none, none, none, none
    q = (anchor - start) // WIDTH
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (q[1:] != q[:-1])
                                         | (start[1:] != start[:-1] + 1)]))
    lo, hi = start[cut], start[np.append(cut[1:], len(start)) - 1]
    return np.searchsorted(offsets, lo, "right") - 1, anchor[cut], q[cut], lo, hi


def _span(anchor: np.ndarray, q: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, end of the core) of a whole piece."""
    most = np.minimum(q * WIDTH + WIDTH - 1, length - GRAM)
    return anchor - most, anchor - q * WIDTH, anchor - most + length


class _Slice:
    """Pieces and core hashes of the texts of a slice that were not seen before in the task."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, seen: set[bytes]):
        raw = data.tobytes()
        self.raw, self.offsets = raw, offsets
        self.nodes = [hashlib.md5(raw[a:z], usedforsecurity=False).digest()
                      for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        fresh = np.zeros(len(self.nodes), bool)
        for i, node in enumerate(self.nodes):
            if node not in seen:
                fresh[i] = True
                seen.add(node)
        if len(seen) > 200_000:
            seen.clear()
        self.first = _Hashes(data)
        self.data = data
        self.text, self.anchor, self.q, self.lo, self.hi = _pieces(data, offsets, length, self.first)
        keep = fresh[self.text]
        self.text, self.anchor, self.q, self.lo, self.hi = (
            x[keep] for x in (self.text, self.anchor, self.q, self.lo, self.hi))
        self.begin, self.core, self.end = _span(self.anchor, self.q, length)
        self.key = self.core_hash(self.first)

    def core_hash(self, hashes: _Hashes) -> np.ndarray:
        return mix64(hashes.of(self.core, self.end) + (self.anchor - self.core + 1).astype(np.uint64))


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[_Slice]:
    seen: set[bytes] = set()
    for _, data, offsets in text_slices(batches, SLICE):
        yield _Slice(data, offsets, length, seen)


def _counts(texts: DataFrame, pick) -> DataFrame:
    """(h, n) of the hashes that ``pick`` takes from each slice."""
    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for h in pick(batches):
            held.append(h)
            if sum(map(len, held)) > 1_000_000:
                yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _windows_of(s: _Slice, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every window of the chosen pieces."""
    size = (s.hi - s.lo + 1)[chosen]
    at = np.repeat(s.lo[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return at, np.repeat(chosen, size)


def blind_trie(strings: list[bytes], rows: list[int]) -> list[int]:
    """Rows in the order of their strings: strings go down by the branching bytes alone and are compared once, with
    the string of the leaf that they reach."""
    def char(row: int, depth: int) -> int:
        return strings[row][depth] if depth < len(strings[row]) else -1

    root = ("leaf", [rows[0]])  # a leaf holds equal rows, a node (depth, {byte: child})
    for row in rows[1:]:
        node = root
        while node[0] != "leaf":
            c = char(row, node[0])
            node = node[1].get(c) or next(iter(node[1].values()))
        other = node[1][0]
        depth = common_prefix(strings[row], strings[other])
        if depth == len(strings[row]) == len(strings[other]):
            node[1].append(row)
            continue
        above, node, by = None, root, None
        while node[0] != "leaf" and node[0] < depth:
            above, by = node, char(row, node[0])
            node = node[1][by]
        if node[0] == depth:
            node[1][char(row, depth)] = ("leaf", [row])
            continue
        split = (depth, {char(other, depth): node, char(row, depth): ("leaf", [row])})
        if above is None:
            root = split
        else:
            above[1][by] = split
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] == "leaf":
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] equals b[:lo], a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def deep_shallow(strings: list[bytes], rows: list[int], shallow: int = SHALLOW) -> list[int]:
    """Rows in the order of their strings: multikey quicksort to a depth, then blind tries."""
    out: list[int] = []
    stack = [(rows, 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            out += blind_trie(strings, group)
        else:
            chars = [strings[r][depth] if depth < len(strings[r]) else -1 for r in group]
            pivot = sorted((chars[0], chars[len(chars) // 2], chars[-1]))[1]
            less = [r for r, c in zip(group, chars, strict=True) if c < pivot]
            same = [r for r, c in zip(group, chars, strict=True) if c == pivot]
            more = [r for r, c in zip(group, chars, strict=True) if c > pivot]
            if more:
                stack.append((more, depth))
            if pivot < 0:  # strings that end here are equal
                if less:
                    stack.append((less, depth))
                out += same
                continue
            stack.append((same, depth + 1))
            if less:
                stack.append((less, depth))
    return out


def _ordered(key: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and string, common prefix with the row before; -1 where the key changes)."""
    by_key = np.argsort(key, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, key[by_key][1:] != key[by_key][:-1])), len(key))
    order: list[int] = []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        order += deep_shallow(strings, by_key[a:z].tolist())
    lcp = np.full(len(key), -1, np.int64)
    same = np.ones(len(key), bool)
    same[cuts[:-1]] = False
    for i in np.flatnonzero(same).tolist():
        lcp[i] = common_prefix(strings[order[i]], strings[order[i - 1]])
    return np.array(order, np.int64), lcp


def repeated_windows(key: np.ndarray, most: np.ndarray, least: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                     left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, distance) of the windows that two pieces of a key share.

    A piece has windows at distances ``lo``..``hi`` of the anchor, within the whole piece's ``least``..``most``; the
    window at distance x takes x - least bytes of the (reversed) left edge and most - x bytes of the right one.
    """
    order_l, lcp_l = _ordered(key, left)
    order_r, lcp_r = _ordered(key, right)
    pieces, distances = [], []
    n = len(key)
    class_l, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for step in range(int((most - least).max()) + 1):
        class_l[order_l] = np.cumsum(lcp_l < step)
        # the right edge is shorter where a whole piece has fewer windows: bytes needed differ by piece, not by key
        need = (most - least - step)
        class_r[order_r] = np.cumsum(lcp_r < need[order_r])
        x = least + step
        live = np.flatnonzero((lo <= x) & (x <= hi))
        if len(live) < 2:
            continue
        pair = class_l[live] * (n + 1) + class_r[live]
        _, first, count = np.unique(pair, return_inverse=True, return_counts=True)
        twice = live[count[first] > 1]
        pieces.append(twice)
        distances.append(x[twice])
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pieces), np.concatenate(distances)


PIECE = "kind int, h long, h2 long, node binary, anchor long, q int, lo long, hi long, left binary, right binary"


def _emit(texts: DataFrame, repeated, hot, windows, length: int) -> DataFrame:
    """Pieces with a repeated core (kind 0); of hot cores, the runs of windows that may repeat, within a piece (kind 1),
    and the hashes of the windows of each different run (kind 2). Positions are within a text."""
    names = [x.split()[0] for x in PIECE.split(", ")]

    def batch(kind: int, nodes: pa.Array, of: np.ndarray, h, h2, lo, hi, anchor=None, q=None, left=None, right=None):
        n = len(of)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)),
             nodes.take(pa.array(of)), pa.nulls(n, pa.int64()) if anchor is None else pa.array(anchor),
             pa.nulls(n, pa.int32()) if q is None else pa.array(q.astype(np.int32)), pa.array(lo), pa.array(hi),
             pa.nulls(n, pa.binary()) if left is None else pa.array(left, pa.binary()),
             pa.nulls(n, pa.binary()) if right is None else pa.array(right, pa.binary())], names)

    def run(batches):
        for s in _slices(batches, length):
            often = hot.value.holds(s.key)
            some = np.flatnonzero(repeated.value.holds(s.key) & ~often)
            if not len(some) and not often.any():
                continue
            second = _Hashes(s.data, 1)
            nodes = pa.array(s.nodes, pa.binary())
            if len(some):
                of = s.text[some]
                begin, limit = s.offsets[of], s.offsets[of + 1]
                edge, last = np.maximum(s.begin[some], begin), np.minimum(s.core[some] + length, limit)
                left = [s.raw[a:z][::-1] for a, z in zip(edge.tolist(), s.core[some].tolist(), strict=True)]
                right = [s.raw[a:z] for a, z in zip(s.end[some].tolist(), last.tolist(), strict=True)]
                yield batch(0, nodes, of, s.key[some], s.core_hash(second)[some], s.lo[some] - begin, s.hi[some] - begin,
                            s.anchor[some] - begin, s.q[some], left, right)
            if often.any():
                at, piece = _windows_of(s, np.flatnonzero(often))
                keep = windows.value.holds(s.first.of(at, at + length))
                at, piece = at[keep], piece[keep]
                if not len(at):
                    continue
                a = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)))
                z = np.append(a[1:], len(at))
                lo, hi, of = at[a], at[z - 1], s.text[piece[a]]
                h, h2 = s.first.of(lo, hi + length), second.of(lo, hi + length)
                base = s.offsets[of]
                yield batch(1, nodes, of, h, h2, lo - base, hi - base)
                # the windows of each different run, once
                _, once = np.unique(h, return_index=True)
                first, other = s.first.of(at, at + length), second.of(at, at + length)
                left = [first[i:j].tobytes() for i, j in zip(a[once].tolist(), z[once].tolist(), strict=True)]
                right = [other[i:j].tobytes() for i, j in zip(a[once].tolist(), z[once].tolist(), strict=True)]
                yield batch(2, nodes, of[once], h[once], h2[once], lo[once] - base[once], hi[once] - base[once],
                            left=left, right=right)

    return texts.mapInArrow(run, PIECE)


def _compare_groups(pieces: DataFrame, groups: int, length: int) -> DataFrame:
    """(node, lo, hi): runs of repeated window starts."""
    def run(group: pa.Table) -> pa.Table:
        empty = pa.table({"node": pa.array([], pa.binary()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
        group = group.combine_chunks()
        cols = {k: group[k].to_numpy() for k in ("h", "h2", "anchor", "lo", "hi")}
        q, node = group["q"].to_numpy().astype(np.int64), group["node"].to_pylist()
        names = {x: i for i, x in enumerate(dict.fromkeys(node))}
        of = np.array([names[x] for x in node])
        # one row for each place, whatever the number of copies of its text
        order = np.lexsort((cols["lo"], q, cols["anchor"], of, cols["h2"], cols["h"]))
        same = np.zeros(len(order), bool)
        same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (
            cols["h"], cols["h2"], of, cols["anchor"], q, cols["lo"])])
        order = order[~same]
        change = np.ones(len(order), bool)
        change[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (cols["h"], cols["h2"], q)])
        key = np.cumsum(change)
        met = np.bincount(key)[key] > 1
        order, key = order[met], key[met]
        if not len(order):
            return empty
        anchor, q, lo, hi = cols["anchor"][order], q[order], cols["lo"][order], cols["hi"][order]
        least = q * WIDTH
        most = np.minimum(least + WIDTH - 1, length - GRAM)
        left = group["left"].take(pa.array(order)).to_pylist()
        right = group["right"].take(pa.array(order)).to_pylist()
        piece, distance = repeated_windows(key, most, least, anchor - hi, anchor - lo, left, right)
        if not len(piece):
            return empty
        start = anchor[piece] - distance
        by = np.lexsort((start, piece))
        piece, start = piece[by], start[by]
        cut = np.append(True, (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1))
        a = np.flatnonzero(cut)
        z = np.append(a[1:], len(start)) - 1
        return pa.table({"node": pa.array([node[order[i]] for i in piece[a].tolist()], pa.binary()),
                         "lo": pa.array(start[a]), "hi": pa.array(start[z])})

    return (pieces.withColumn("g", F.pmod("h", F.lit(groups))).groupBy("g")
            .applyInArrow(run, "node binary, lo long, hi long"))


def _hot_runs(found: DataFrame) -> DataFrame:
    """(node, lo, hi) of repeated windows of hot cores: each different run of windows is looked at once, with the
    number of places that it has, and the answer goes back to its places."""
    def windows(batches):
        for batch in batches:
            for h, h2, left, right in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)
                n = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, h)), pa.array(np.full(n, h2)), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(a), pa.array(b)], ["h", "h2", "at", "w", "w2"])

    places = stage(found.where("kind = 1").select("h", "h2", "node", "lo").distinct(), "hot-places")
    count = places.groupBy("h", "h2").agg(F.count("lo").alias("n"))
    runs = (found.where("kind = 2").groupBy("h", "h2").agg(F.first("left").alias("left"), F.first("right").alias("right"))
            .mapInArrow(windows, "h long, h2 long, at int, w long, w2 long"))
    listed = stage(runs.join(count, ["h", "h2"]), "hot-windows")
    twice = listed.groupBy("w", "w2").agg(F.sum("n").alias("total")).where("total > 1").select("w", "w2")
    good = listed.join(twice, ["w", "w2"]).groupBy("h", "h2").agg(F.array_sort(F.collect_set("at")).alias("at"))
    return (places.join(good, ["h", "h2"]).select("node", F.explode(_ranges("at", "lo")).alias("r"))
            .select("node", "r.lo", "r.hi"))


def _ranges(at: str, lo: str):
    """Runs of neighbouring numbers of a sorted array, moved by ``lo``."""
    x = F.col(at)
    first = F.filter(x, lambda v, i: (i == 0) | (F.get(x, i - 1) != v - 1))
    last = F.filter(x, lambda v, i: (i == F.size(x) - 1) | (F.get(x, i + 1) != v + 1))
    return F.zip_with(first, last, lambda a, b: F.struct((a + F.col(lo)).alias("lo"), (b + F.col(lo)).alias("hi")))


def repeated_runs(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(node, runs): sorted window starts (lo, hi) of each text, by md5, that repeat elsewhere; short texts have none."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= length)
    cores = stage(_counts(texts, lambda batches: (s.key for s in _slices(batches, length))).where("n > 1"), "cores")
    repeated = spark.sparkContext.broadcast(bitmap(cores, "h", SHIFTS))
    hot = spark.sparkContext.broadcast(bitmap(cores.where(F.col("n") > HOT), "h", SHIFTS))

    def hot_windows(batches):
        for s in _slices(batches, length):
            at, _ = _windows_of(s, np.flatnonzero(hot.value.holds(s.key)))
            if len(at):
                yield s.first.of(at, at + length)

    if hot.value.bits.any():
        windows = bitmap(_counts(texts, hot_windows).where("n > 1"), "h", SHIFTS)
    else:
        windows = Bitmap(bytes(len(hot.value.bits)), SHIFTS)
    found = stage(_emit(texts, repeated, hot, spark.sparkContext.broadcast(windows), length), "pieces")
    pieces = found.where("kind = 0")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.count() // 20_000)
    runs = _compare_groups(pieces, groups, length).union(_hot_runs(found))
    return runs.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, kept binary, n_bytes, spans array<struct<lo,hi>>): bytes left of every row, and the removed spans [lo, hi)."""
    node = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"),
                       node.alias("node"))
    runs = stage(repeated_runs(docs, text, length), "runs")
    copies = (docs.where(F.octet_length(text) >= length).groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("node", F.lit(True).alias("whole")))
    marks = runs.join(copies, "node", "full").select("node", "runs", F.coalesce("whole", F.lit(False)).alias("whole"))
    marks = stage(marks, "marks")
    kind = dict(rows.dtypes)["key"]

    def run(batches):
        for batch in batches:
            keys, whole, starts = batch.column(0), batch.column(3).to_pylist(), batch.column(2).to_pylist()
            kept, spans = [], []
            for body, all_of_it, found in zip(batch.column(1), whole, starts, strict=True):
                body = body.as_py()
                cut = [(0, len(body))] if all_of_it else []
                for x in [] if all_of_it else found or []:
                    lo, hi = x["lo"], x["hi"] + length
                    if cut and lo <= cut[-1][1]:
                        cut[-1] = (cut[-1][0], max(hi, cut[-1][1]))
                    else:
                        cut.append((lo, hi))
                edges = [0, *(e for c in cut for e in c), len(body)]
                kept.append(b"".join(body[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"lo": a, "hi": z} for a, z in cut])
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(kept, pa.binary()), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                ["key", "kept", "n_bytes", "spans"])

    joined = rows.join(marks, "node", "left").select("key", "bytes", "runs", F.coalesce("whole", F.lit(False)).alias("whole"))
    out = joined.mapInArrow(run, f"key {kind}, kept binary, n_bytes long, spans array<struct<lo:long,hi:long>>")
    return out.withColumnRenamed("key", key)
