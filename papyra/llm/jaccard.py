"""N-gram Jaccard join: metric-space join of documents' sets of word shingles, recursive and exact.

Documents with equal sets form one class. Jaccard distance is a metric, but most documents share nothing and lie at
distance 1 from everything, where no pivot separates them. The first level of regions is therefore given by pivots
that are single shingles: a set is replicated to its ``n - ceil(0.75 n) + 1`` first shingles in a global order (common
shingles last, else by hash), and two sets within the threshold meet in one of these regions at least. With ``m`` shingles
more in the prefix, two such sets share ``m + 1`` of them, so a set with fewer shingles there that any other class
holds early as well has no partner and stops here. Among the candidates that are left, a set with less than three
quarters of shared shingles stops as well, and the order is drawn up anew with shingles that no other candidate holds
first and frequent ones last, so that passages which many documents share open few regions. Before a region is cut into
cells its members are compared with one member each, the one that they share most regions with: groups of copies become
components, and a region of one component is done. Within a region that is still open
the pivots are documents: every member's distance to the pivots is computed, members that link with a pivot form its
Voronoi cell (the nearest pivot of their component), and, by the triangle inequality, a member can link across its
cell only if its distance to the pivot is no less than the distance of the nearest outsider less the threshold; the
members within that window and those of no cell join the next level, with more pivots. For an outsider a lower bound of
the distance will do, for the member itself only the distance: a member whose distance to no pivot of its component was
computed is of no cell. Regions of at most LEAF members, and after LEVELS levels all others, are finished pair by pair in
blocks of members: a task bounds the pairs of two blocks by products of 0/1 matrices, and only pairs of different components
that the bound lets link leave it. Members that are connected already, or that meet in a larger region, are not compared
again: a region's largest such group is dealt to the other members' blocks only, once where those fit into one block.

Regions grow with the number of documents that share a rare shingle, not with the corpus, and are never gathered: they
are rows of a table, and pivots meet them in joins whose large keys Spark can split. Bitmaps of fixed size (16 MB), two
at a time, are broadcast: one marks common shingles, one the shingles that two classes have in their prefixes, or anywhere
(Bloom filters; what they let through wrongly is compared exactly and dropped).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (lower_bytes, mix64, segment_ids, span_hashes, stage, text_slices, window_hashes, word_bounds)
from .components import FEW, components, few_components

WORDS = 5
PERCENT = 75
SCAN = 16  # common shingles are looked for among the first sixteenth of each set, in hash order
COMMON = 5  # occurrences there beyond which a shingle comes last in the global order
MORE = 10  # shingles of a set for each further shingle that a partner must share early on
OFTEN = 8  # candidate classes that hold a shingle beyond which it comes last among the candidates
VOTES = 2  # rounds in which a member is compared with the one partner that it shares most regions with
LEAF = 2048  # members of a region that needs no further pivots
LEVELS = 4  # levels of pivots; a level has twice as many as the one before
SIDE = 256  # members of a block
PACK = 1024  # rows of blocks that one call in a task handles
WIDE = 1 << 13  # columns of a 0/1 matrix
SLOT_BITS = 27  # 2^27 bits: 16 MB
SHIFTS = (0, 27, 37)  # three slots of a 64-bit hash
_MASK = (1 << SLOT_BITS) - 1
_HIGH = np.uint64(0xFFFFFFFFFF000000)
_LOW = np.uint64(0xFFFFFFFFFF)
HIGH_SHIFTS = (24, 31, 37)  # slots of a hash of which the upper 40 bits are known


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of each text of a slice, in order."""
    n = len(offsets) - 1
    low = lower_bytes(data)
    starts, ends = word_bounds(low, offsets)
    h = span_hashes(low, starts, ends)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    runs = window_hashes(h, k)
    at = np.arange(len(runs))
    of = segment_ids(offsets, starts[:len(runs)]) if len(runs) else np.zeros(0, np.int64)
    inside = at + k <= first[of + 1] if len(runs) else np.zeros(0, bool)
    short = np.flatnonzero((words > 0) & (words < k))
    own = np.array([window_hashes(h[first[i]:first[i + 1]], int(words[i]))[0] for i in short], np.uint64)
    runs = np.concatenate([runs[inside], mix64(own + words[short].astype(np.uint64))])
    of = np.concatenate([of[inside], short])
    packed = (of.astype(np.uint64) << np.uint64(44)) | (runs >> np.uint64(20))
    order = np.argsort(packed)
    tied = np.diff(packed[order]) == 0
    if (runs[order][1:][tied] != runs[order][:-1][tied]).any():  # equal in the packed bits only
        order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    runs, of = runs[fresh], of[fresh]
    return runs, np.searchsorted(of, np.arange(n + 1))


def _class_ids(runs: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    raw = runs.tobytes()
    return [hashlib.blake2b(raw[8 * a:8 * z], digest_size=16).digest() if z > a else None
            for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, node): size of each row's set and the class of equal sets (null for an empty set)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for rows, data, offsets in text_slices(batches):
            runs, bounds = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds)),
                                              pa.array(_class_ids(runs, bounds), pa.binary())], ["key", "n", "node"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, n long, node binary").withColumnRenamed("key", key)


class Bitmap:
    """Fixed-size set of 64-bit hashes: one or more slots each."""

    def __init__(self, bits: bytes, shifts: tuple[int, ...]):
        self.bits, self.shifts = np.frombuffer(bits, np.uint8), shifts

    def __getstate__(self):  # few bits of a small input are set
        return zlib.compress(self.bits.tobytes(), 1), self.shifts

    def __setstate__(self, state):
        self.__init__(zlib.decompress(state[0]), state[1])

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for s in self.shifts:
            slot = ((h >> np.uint64(s)) & np.uint64(_MASK)).astype(np.int64)
            out &= (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        return out


def bitmap(hashes: DataFrame, column: str, shifts: tuple[int, ...]) -> Bitmap:
    """The bitmap of a column of hashes: built by Spark, at most 2^SLOT_BITS bits reach the driver."""
    slots = F.array(*[F.shiftrightunsigned(column, s).bitwiseAND(F.lit(_MASK)) + 1 for s in shifts])
    rows = (hashes.select(F.explode(slots).alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect())
    out = bytearray(1 << (SLOT_BITS - 3))
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] = r["bits"]
    return Bitmap(bytes(out), shifts)


def _further(size: np.ndarray) -> np.ndarray:
    """Shingles by which the longer prefix of a set exceeds the shortest one."""
    return size // MORE


def _order(runs: np.ndarray, bounds: np.ndarray, common: Bitmap | list[Bitmap] | None
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in ``runs``, text, rank in the text's set) of all shingles in the global order: those in more of the
    bitmaps later, else by hash."""
    size = np.diff(bounds)
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(runs))
    last = common if isinstance(common, list) else [] if common is None else [common]
    if last:
        level = sum(b.holds(runs).astype(np.int64) for b in last)
        at = np.argsort((len(last) + 1) * of + level, kind="stable")  # within a text the hashes are in order already
    return at, of, np.arange(len(runs)) - np.repeat(bounds[:-1], size)


def _shortest(size: np.ndarray) -> np.ndarray:
    """Prefix length at which two sets within the threshold share a shingle."""
    return size - -(-PERCENT * size // 100) + 1


def _sets(batches: Iterator[pa.RecordBatch]):
    for _, data, offsets in text_slices(batches):
        yield shingle_sets(data, offsets)


def _common(texts: DataFrame) -> Bitmap:
    """Shingles that the first parts of more than COMMON sets hold, in hash order. Any choice gives right results; this
    one keeps shared passages out of the prefixes."""
    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for runs, bounds in _sets(batches):
            at, of, rank = _order(runs, bounds, None)
            held.append(runs[at[rank <= np.diff(bounds)[of] // SCAN]])
            if sum(map(len, held)) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    counted = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return bitmap(counted.where(F.col("n") > COMMON), "h", SHIFTS[:1])


def _met(texts: DataFrame, common) -> Bitmap:
    """Shingles in the longer prefixes of two classes or more, by the upper 40 bits of their hash.

    A class shows beside a shingle as a 64-bit hash of both (24 bits beside the shingle's 40, 40 in a second column):
    one shingle at which two classes are mistaken for one can be all that a pair of small sets has. A task reports a
    shingle once, or twice if it met two classes.
    """
    def run(batches):
        for runs, bounds in _sets(batches):
            size = np.diff(bounds)
            at, of, rank = _order(runs, bounds, common.value)
            early = rank < (_shortest(size) + _further(size))[of]
            at, of = at[early], of[early]
            nodes = np.array([int.from_bytes(x[:8], "little") if x else 0 for x in _class_ids(runs, bounds)], np.uint64)
            mark = mix64(nodes[of] ^ runs[at])
            v = (runs[at] & _HIGH) | (mark >> np.uint64(40))
            order = np.argsort(v)
            v, m = v[order], mark[order] & _LOW
            first = np.flatnonzero(np.append(True, (v[1:] ^ v[:-1]) & _HIGH)) if len(v) else np.zeros(0, np.int64)
            own = np.repeat(first, np.diff(np.append(first, len(v))))
            other = np.where((v != v[own]) | (m != m[own]), np.arange(len(v)), -1)
            other = np.maximum.reduceat(other, first) if len(v) else first
            told = np.concatenate([first, other[other >= 0]])
            yield pa.RecordBatch.from_arrays([pa.array(v[told].view(np.int64)), pa.array(m[told].view(np.int64))],
                                             ["v", "m"])

    def meet(batches):
        last_v = last_m = np.zeros(0, np.int64)  # the run of equal shingles may go on in the next batch
        for batch in batches:
            v = np.concatenate([last_v, batch.column(0).to_numpy()])
            m = np.concatenate([last_m, batch.column(1).to_numpy()])
            high = v >> 24
            # the second column is in no order, but where a run holds two classes some neighbours differ
            twice = (high[1:] == high[:-1]) & ((v[1:] != v[:-1]) | (m[1:] != m[:-1]))
            last_v, last_m = v[-1:], m[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(high[1:][twice] << 24)], ["h"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (texts.mapInArrow(run, "v long, m long").repartition(n, F.shiftright("v", 24)).sortWithinPartitions("v")
           .mapInArrow(meet, "h long"))
    return bitmap(met, "h", HIGH_SHIFTS)


def _candidates(texts: DataFrame, common, met) -> DataFrame:
    """(node, n, items) of the classes that may have a partner, by the shingles that they share early on.

    A class comes once per task that meets it.
    """
    def run(batches):
        seen: set[bytes] = set()
        for runs, bounds in _sets(batches):
            some, _ = _meeting(runs, bounds, common.value, met.value)
            ids = _class_ids(runs, bounds)
            rows = []
            for i in some.tolist():
                if ids[i] not in seen:
                    seen.add(ids[i])
                    rows.append(i)
            if len(seen) > 200_000:
                seen.clear()
            if rows:
                signed = runs.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in rows], pa.binary()), pa.array(np.diff(bounds)[rows]),
                    pa.array([signed[bounds[i]:bounds[i + 1]] for i in rows], pa.list_(pa.int64()))], ["node", "n", "items"])

    return texts.mapInArrow(run, "node binary, n long, items array<long>")


def _meeting(runs: np.ndarray, bounds: np.ndarray, common: Bitmap, met: Bitmap) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sets that share enough of their longer prefix with any others, the shared positions of each one's shortest prefix)."""
    size = np.diff(bounds)
    at, of, rank = _order(runs, bounds, common)
    early = rank < (_shortest(size) + _further(size))[of]
    at, of, rank = at[early], of[early], rank[early]
    hit = met.holds(runs[at])
    at, of, rank = at[hit], of[hit], rank[hit]
    # the smallest set that may link has 3/4 of the shingles, and so the least that a partner must share
    needed = _further(-(-PERCENT * size // 100)) + 1
    enough = (np.bincount(of, minlength=len(size)) >= needed) & (size > 0)
    short = rank < _shortest(size)[of]
    at, of = at[short], of[short]
    cuts = np.searchsorted(of, np.arange(len(bounds)))
    some = np.flatnonzero(enough & (np.diff(cuts) > 0))
    return some, [at[cuts[i]:cuts[i + 1]] for i in some.tolist()]


def _shared(raw: DataFrame) -> tuple[Bitmap, Bitmap]:
    """Shingles that two and more candidate classes hold anywhere in their sets, and those that more than OFTEN hold."""
    held = raw.select(F.xxhash64("node").alias("c"), F.explode("items").alias("h"))
    counted = held.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("c").alias("n"))
    counted = stage(counted.where("c0 <> c1").select("h", (F.col("n") > OFTEN).alias("often")), "shared-shingles")
    return bitmap(counted, "h", SHIFTS), bitmap(counted.where("often"), "h", SHIFTS[:1])


def _refined(raw: DataFrame, often, shared) -> DataFrame:
    """(node, n, tokens, small, items): the candidates that may have a partner among the candidates.

    A set links only if others hold three quarters of all its shingles, anywhere; and in an order in which shingles that
    no other candidate holds come first and frequent ones last, its prefix must meet another's. Tokens are the shared
    shingles of that prefix: a passage that many documents share is hardly among them.
    """
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            runs = lists.values.to_numpy()[bounds[0]:bounds[-1]].view(np.uint64)
            bounds = bounds - bounds[0]
            size = np.diff(bounds)
            total = np.zeros(len(runs) + 1, np.int64)
            np.cumsum(shared.value.holds(runs), out=total[1:])
            full = 100 * (total[bounds[1:]] - total[bounds[:-1]]) >= PERCENT * size
            order = [shared.value, often.value]
            some, at = _meeting(runs, bounds, order, shared.value)
            keep = full[some]
            rows, at = some[keep], [x for x, k in zip(at, keep.tolist(), strict=True) if k]
            signed = runs.view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(size[rows]), pa.array([signed[x] for x in at], pa.list_(pa.int64())),
                pa.array([np.unique((runs[bounds[i]:bounds[i + 1]] >> np.uint64(20)).astype(np.uint16)).view(np.int16)
                          for i in rows.tolist()], pa.list_(pa.int16())),
                batch.column(2).take(pa.array(rows))], ["node", "n", "tokens", "small", "items"])

    return raw.mapInArrow(run, "node binary, n long, tokens array<long>, small array<smallint>, items array<long>")


def _near_size(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def _bound(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total, near): an upper bound of the intersection of pairs of classes, from 16 bits of each
    shingle, and whether it lets them link. Shingles that coincide in the 16 bits are added back."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("small").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("small").alias("y"))
    most = F.size(F.array_intersect("x", "y")) + F.least(F.col("nx") - F.size("x"), F.col("ny") - F.size("y"))
    total = F.col("nx") + F.col("ny")
    found = pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.least(most, "nx", "ny").cast("long").alias("inter"), total.alias("total"))
    return found.withColumn("near", _linked())


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total, exact) of pairs of classes (a, b)."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("nx"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("ny"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("inter"), (F.col("nx") + F.col("ny")).alias("total"),
        F.lit(True).alias("exact"))


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total, exact) of pairs of classes (a, b); where the bound rules a link out, ``inter`` is the bound
    and ``exact`` is false."""
    bounded = stage(_bound(pairs, sets), "bounded")
    exact = _exact(bounded.where("near").select("a", "b"), sets)
    return bounded.where("not near").select("a", "b", "inter", "total", F.lit(False).alias("exact")).unionByName(exact)


def _linked() -> Column:
    return F.col("inter") * 100 >= (F.col("total") - F.col("inter")) * PERCENT


def _ordered(p: Column, q: Column) -> list[Column]:
    return [F.least(p, q).alias("a"), F.greatest(p, q).alias("b")]


def _roots(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("root", F.col("node"))
    return members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def links(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """((class, node), (node, root) of linked classes or None, compared pairs (a, b, inter, total, exact)).

    Classes that may have a partner are numbered (``node``). The compared pairs that link span every component; pairs
    inside a known component need not all be there.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    common = spark.sparkContext.broadcast(_common(texts))
    met = spark.sparkContext.broadcast(_met(texts, common))
    candidates = stage(_candidates(texts, common, met), "candidates")
    common.destroy()
    met.destroy()
    shared, often = (spark.sparkContext.broadcast(b) for b in _shared(candidates))
    found_sets = _refined(candidates, often, shared).withColumn("number", F.monotonically_increasing_id())
    raw = stage(found_sets, "candidate-sets")  # numbered when stored; a class goes by its smallest number
    shared.destroy()
    often.destroy()
    names = stage(raw.groupBy(F.col("node").alias("class")).agg(F.min("number").alias("node")), "class-numbers")
    sets = raw.select(F.col("number").alias("node"), "n", "small", "items")
    members = stage(raw.select(F.col("number").alias("node"), "n", "tokens").join(names.select("node"), "node")
                    .select("node", "n", F.explode("tokens").alias("region")), "members")
    # regions with the same members are one region
    kinds = (members.groupBy("region").agg(
        F.count("node").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("size > 1")
        .groupBy("size", "x", "y").agg(F.min("region").alias("region")).select("region"))
    members = stage(members.join(kinds, "region"), "regions")
    members, compared, found = _votes(members, sets)
    members = _shares(_roots(members, found))
    epsilon = 1 - PERCENT / 100
    closing: DataFrame | None = None
    for level in range(LEVELS):
        if members.isEmpty():
            break
        # one member of each component, the largest components first: their cells lose most members
        first = members.groupBy("region", "root").agg(F.min(F.struct("node", "n")).alias("p"), F.first("share").alias("share"))
        order = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("share"), "p.node"))
        pivots = first.withColumn("i", order).where(F.col("i") <= 2 << level).select("region", "p.node", "p.n")
        pivots = stage(pivots.select("region", F.col("node").alias("pivot"), F.col("n").alias("pn")), "pivots")
        met_at = members.select("region", "node", "n").join(pivots, "region").where("node <> pivot")
        near = met_at.where(_near_size(F.col("n"), F.col("pn")))
        compared, fresh = _extend(compared, near.select(*_ordered(F.col("node"), F.col("pivot"))).distinct(), sets)
        found = _components(found, fresh)
        placed = _roots(members.select("region", "node", "n"), found)
        # distance of every member to every pivot: a lower bound where the sizes or the 16 bits rule a link out
        far = 1 - F.least("n", "pn") / F.greatest("n", "pn")
        near_d = 1 - F.col("inter") / (F.col("total") - F.col("inter"))
        pair = _ordered(F.col("node"), F.col("pivot"))
        spread = (met_at.withColumns({"a": pair[0], "b": pair[1]}).join(compared, ["a", "b"], "left")
                  .select("region", "node", "pivot", F.coalesce(near_d, far).alias("d"),
                          F.coalesce("exact", F.lit(False)).alias("exact")))
        proots = _roots(pivots.select("region", F.col("pivot").alias("node")), found).select(
            "region", F.col("node").alias("pivot"), F.col("root").alias("proot"))
        measured = stage(spread.join(placed.select("region", "node", "root"), ["region", "node"])
                         .join(proots, ["region", "pivot"]), "distances")
        outside = (measured.where("root <> proot").groupBy("region", "pivot").agg(F.min("d").alias("nearest")))
        # a lower bound of the member's own distance would let the window drop it too early
        cell = (measured.where("root = proot and exact").groupBy("region", "node")
                .agg(F.min(F.struct("d", "pivot")).alias("c")).select("region", "node", "c.d", "c.pivot"))
        inner = (cell.join(outside, ["region", "pivot"], "left")
                 .select("region", "node", F.coalesce(F.col("d") >= F.col("nearest") - epsilon - 1e-9, F.lit(False))
                         .alias("window")))
        kept = (placed.join(inner, ["region", "node"], "left").where(F.coalesce("window", F.lit(True)))
                .join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti"))
        kept = stage(kept.select("region", "node", "n", "root"), "kept")
        open_ = (kept.groupBy("region").agg(F.count("node").alias("size"), F.min("root").alias("r0"),
                                            F.max("root").alias("r1")).where("r0 <> r1").select("region", "size"))
        rest = kept.join(open_, "region")
        done = rest if level == LEVELS - 1 else rest.where(F.col("size") <= LEAF)
        done = done.select("region", "node", "n")
        closing = done if closing is None else closing.unionByName(done)
        if level < LEVELS - 1:
            members = _shares(rest.where(F.col("size") > LEAF))
    # the best pair of a member and another component links them nearly always, and few pairs are left for the second round
    for best in (True, False) if closing is not None else ():
        pairs = _block_pairs(closing, found, sets, best)
        if pairs is None:
            break
        pairs = stage(pairs.distinct().join(compared.where("exact").select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        fresh = stage(_exact(pairs, sets), "compared")
        compared = compared.unionByName(fresh)
        found = _components(found, fresh)
    if compared is None:
        compared = spark.createDataFrame([], "a long, b long, inter long, total long, exact boolean")
    return names, found, compared


def _block_pairs(closing: DataFrame, found: DataFrame | None, sets: DataFrame, best: bool) -> DataFrame | None:
    """(a, b): pairs of members (region, node, n) that share a region, are of different components and may link by 16 bits of
    each shingle; with ``best``, of a member and another component in a pair of blocks only the pair of the largest bound.

    Small blocks travel together. None where no region holds two components.
    """
    dealt = _dealt(closing, found)
    if dealt is None:
        return None
    rows, copies = dealt
    packs = -(-copies // PACK)
    rows = (rows.join(sets.select("node", "small"), "node").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            .withColumns({"i": F.least("own", "k"), "j": F.greatest("own", "k")}))
    rows = rows.select(F.pmod(F.xxhash64("region", "i", "j"), F.lit(packs)).alias("pack"), "region", "i", "j", "own", "node",
                       "n", "root", "top", "small")
    return rows.groupBy("pack").applyInArrow(lambda t: _pairs_of_pack(t, best), "a long, b long")


def _dealt(closing: DataFrame, found: DataFrame | None) -> tuple[DataFrame, int] | None:
    """((region, node, n, root, top, own, copies), sum of copies): the members (region, node, n) of regions of two components and
    more, dealt into blocks of about SIDE; None where no region holds two components.

    Members of one component are not compared, and members of the same largest region (``top``) are compared there and
    in no other region that they share. The larger of these two groups is the core of a region: its blocks meet the
    blocks of the other members, which all meet each other, and never one another. A member of block ``own`` goes to
    the pairs of its block and the first ``copies`` blocks; core blocks come last.
    """
    placed = _roots(closing, found)
    kinds = placed.groupBy("region", "root").agg(F.count("node").alias("c"))
    open_ = kinds.groupBy("region").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("joined"),
                                        F.count("root").alias("kinds")).where("kinds > 1").drop("kinds")
    largest = F.max(F.struct("size", "region")).over(Window.partitionBy("node"))
    placed = stage(placed.join(open_, "region").withColumn("top", largest["region"]), "closing")
    met = (placed.where("top <> region").groupBy("region", "top").agg(F.count("node").alias("c"))
           .groupBy("region").agg(F.max(F.struct("c", "top")).alias("met")))
    # of each open region: whether it has a core, of which kind, and its blocks
    size, core = F.col("size"), F.greatest("joined.c", F.coalesce("met.c", F.lit(0)))
    blocks = lambda x: F.ceil(x / SIDE)
    apart = core * blocks(size - core) + (size - core) * (blocks(size - core) + blocks(core)) < size * blocks(size)
    plan = placed.select("region", "size", "joined").distinct().join(met, "region", "left").select(
        "region", apart.alias("apart"), F.when(F.col("met.c") > F.col("joined.c"), F.col("met.top")).alias("mtop"),
        F.col("joined.root").alias("jroot"), blocks(F.when(apart, size - core).otherwise(size)).cast("int").alias("free"),
        F.when(apart, blocks(core)).otherwise(0).cast("int").alias("held"))
    inside = F.col("apart") & F.when(F.col("mtop").isNotNull(), F.col("top") == F.col("mtop")).otherwise(F.col("root") == F.col("jroot"))
    rows = placed.join(plan, "region").withColumn("inside", inside)
    own = F.when(F.col("inside"), F.col("free") + F.pmod(F.xxhash64("node"), F.col("held"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("free"))).cast("int")
    copies = F.when(F.col("inside"), F.col("free")).otherwise(F.col("free") + F.col("held"))
    rows = rows.select("region", "node", "n", "root", "top", own.alias("own"), copies.alias("copies")).where("copies > 0")
    rows = stage(rows, "dealt")
    total = rows.agg(F.sum("copies")).first()[0]
    return (rows, total) if total else None


def _pairs_of_pack(rows: pa.Table, best: bool) -> pa.Table:
    """The pairs (a, b) of ``_block_pairs`` for the rows of a few pairs of blocks."""
    region, i, j, own, node, n, root, top = (
        rows[c].to_numpy() for c in ("region", "i", "j", "own", "node", "n", "root", "top"))
    lists = rows["small"].combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    values, at = lists.values.to_numpy().view(np.uint16), lists.offsets.to_numpy()
    order = np.lexsort((j, i, region))
    new = np.append(True, (np.diff(region[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0))
    out: list[np.ndarray] = []
    for same in np.split(order, np.flatnonzero(new)[1:]):
        left = same[own[same] == i[same[0]]]
        right = same[own[same] == j[same[0]]]
        if not len(left) or not len(right) or (root[same] == root[same[0]]).all():
            continue
        held = [values[at[r]:at[r + 1]] for r in same]
        size = np.array([len(x) for x in held])
        both = np.bincount(np.concatenate(held), minlength=1 << 16) > 1
        column = np.cumsum(both) - 1
        line = np.repeat(np.arange(len(same)), size)
        flat = np.concatenate(held)
        line, flat = line[both[flat]], column[flat[both[flat]]]
        place = np.empty(len(rows), np.int64)
        place[same] = np.arange(len(same))
        x, y = place[left], place[right]
        inter = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, int(both.sum()), WIDE):
            part = (flat >= low) & (flat < low + WIDE)
            m = np.zeros((len(same), min(WIDE, int(both.sum()) - low)), np.float32)
            m[line[part], flat[part] - low] = 1
            inter += m[x] @ m[y].T
        over = n[same] - size
        total = n[left][:, None] + n[right][None, :]
        inter = np.minimum(inter + np.minimum(over[x][:, None], over[y][None, :]),
                           np.minimum(n[left][:, None], n[right][None, :])).astype(np.int64)
        near = (100 * inter >= PERCENT * (total - inter)) & (root[left][:, None] != root[right][None, :])
        near &= (top[left][:, None] != top[right][None, :]) | (top[left] == region[same[0]])[:, None]
        u, v = np.nonzero(near)
        if not len(u):
            continue
        if best:
            bound = inter[u, v] / (total[u, v] - inter[u, v])
            keep = np.zeros(len(u), bool)
            for mine, other in ((u, root[right][v]), (v, root[left][u])):
                ranked = np.lexsort((-bound, other, mine))
                keep[ranked[np.append(True, (np.diff(mine[ranked]) != 0) | (np.diff(other[ranked]) != 0))]] = True
            u, v = u[keep], v[keep]
        out.append(np.stack([node[left][u], node[right][v]]))
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], names=["a", "b"])


def _shares(placed: DataFrame) -> DataFrame:
    """Members (region, node, n, root) with the number of their component's members in the region."""
    share = placed.groupBy("region", "root").agg(F.count("node").alias("share"))
    return stage(placed.join(share, ["region", "root"]).select("region", "node", "n", "root", "share"), "members")


def _votes(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(members of the regions that are still open, compared pairs, components) after a few rounds in which each member is compared
    with one partner: of the first members of other components in its regions, the one that it meets most often.

    A round compares at most one pair per member, however large a group of copies is, and a region whose members are of
    one component has nothing left to find.
    """
    compared: DataFrame | None = None
    found: DataFrame | None = None
    for _ in range(VOTES):
        if members.isEmpty():
            return members, compared, found
        placed = _roots(members, found)
        ends = placed.groupBy("region").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
        placed = stage(placed.join(ends, "region"), "open-regions")
        members = placed.select("region", "node", "n")
        first = placed.where("root = r0 or root = r1").groupBy("region", "root").agg(F.min(F.struct("node", "n")).alias("p"))
        first = first.select("region", F.col("root").alias("facing"), F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"))
        facing = F.when(F.col("root") == F.col("r0"), F.col("r1")).otherwise(F.col("r0"))
        met = placed.withColumn("facing", facing).join(first, ["region", "facing"]).where(_near_size(F.col("n"), F.col("pn")))
        votes = met.groupBy(*_ordered(F.col("node"), F.col("pivot"))).agg(F.count("region").alias("votes"))
        if compared is not None:
            votes = votes.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        each = votes.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "votes")
        picked = each.groupBy("node").agg(F.max(F.struct("votes", "a", "b")).alias("v"))
        pairs = stage(picked.select("v.a", "v.b").distinct(), "voted")
        if pairs.isEmpty():
            break
        fresh = stage(_exact(pairs, sets), "compared")  # at most one pair per member: most of the first round link
        compared = fresh if compared is None else compared.unionByName(fresh)
        found = _components(found, fresh)
    placed = _roots(members, found)
    ends = placed.groupBy("region").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    return stage(members.join(ends.select("region"), "region"), "open-regions"), compared, found


def _extend(compared: DataFrame | None, pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``compared`` with the pairs that are not in it yet, those pairs or None); they are a table of their own, and no pair is
    written again."""
    fresh = pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti")
    fresh = stage(fresh, "pairs")
    if compared is not None and fresh.isEmpty():
        return compared, None
    # few sets are asked for: those alone move
    asked = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    few = stage(sets.join(asked, "node", "left_semi"), "asked-sets")
    fresh = stage(_compare(fresh, few), "compared")
    return (fresh if compared is None else compared.unionByName(fresh)), fresh


def _components(found: DataFrame | None, fresh: DataFrame | None) -> DataFrame | None:
    """(node, root) of the linked nodes, from those known so far and freshly compared pairs. Few links go to one task with those
    known; many join roots, and only the roots that they join are looked at."""
    if fresh is None:
        return found
    links = fresh.where(_linked()).select("a", "b")
    n = links.count()
    if not n:
        return found
    if n + (found.count() if found is not None else 0) <= FEW:
        known = links if found is None else links.union(found.select("node", "root"))
        return stage(few_components(known), "components")
    if found is None:
        return stage(components(links), "components")
    a, b = (found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    joined = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
    joined = stage(joined, "joined-roots")
    if joined.isEmpty():
        return found
    top = stage(components(joined), "components")
    moved = found.join(top.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left")
    moved = moved.select("node", F.coalesce("over", "root").alias("root"))
    return stage(moved.unionByName(top.join(found, "node", "left_anti")), "components")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; the component's id is its smallest key.

    A document without words has an empty set and links with nothing; one of fewer words than a shingle has its whole
    word sequence as its only shingle. A null key takes part in links but names a component only if no other key does.
    """
    rows = stage(classes(docs, key, text).withColumnRenamed(key, "key"), "classes")
    names, found, _ = links(docs, text)
    smallest = stage(rows.where("node is not null").groupBy("node").agg(F.min("key").alias("least")), "smallest")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "node long, root long")
    # classes without links are components of their own
    linked = names.join(found, "node").join(smallest.withColumnRenamed("node", "class"), "class")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.select("class", "root").join(least, "root").select(F.col("class").alias("node"), "component")
    return (rows.join(smallest, "node", "left").join(named, "node", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component", "least", "key").alias("component_id")))
