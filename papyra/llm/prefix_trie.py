"""Prefix trie of conversations, built by van Emde Boas recursion.

A sequence problem of depth 2^k is cut at half its depth: the cut prefixes are named, the trie of the cut prefixes (the
upper trie) and the tries below them (the lower forests) are problems of depth 2^(k-1), and the totals of the lower
forests are grafted onto the upper trie. All problems of one depth are cut in one Spark job, so the trie of sequences of
up to D turns takes log2(D) jobs, and because equal sequences of a problem are one weighted item the work is linear in
the number of turns.

Names. A turn is the MD5 of its role and text; a block of 2^k turns is the MD5 of its two halves (``blocks``), and a
prefix is the MD5 of the names along the cuts that lead to it. An item is a sequence of turns below a named prefix:
``root`` (the prefix), ``start`` (its depth), ``left`` (turns of the item), ``content`` (their hash), ``conv`` (smallest
conversation that holds it), ``weight`` (conversations). ``ends`` marks the item at whose end whole sequences end,
``below`` the name under which the node at the item's end roots a lower forest.

Three passes: ``_cut`` goes down and leaves one item per trie edge; ``_graft`` goes up and sums each lower forest;
``_spread`` goes down again and adds the sum of each lower forest to all nodes of the path above its cut.

No join or group gathers a hot key: items meet their blocks by (conversation, block), one row each; equal prefixes and
copies are summed before they are shuffled; children meet a parent that has many of them by a broadcast of at most
``HEAVY`` parents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

ROOT = b""  # name of the textless prefix
HEAVY = 1000  # a parent is broadcast when it has more than 1/HEAVY of all nodes as children: HEAVY parents at most
IDS = 13  # conversation ids are listed in runs of 2^IDS possible ids
_SUMS = ("leaves", "saved")


def _name(root: Column, content: Column) -> Column:
    return F.unhex(F.md5(F.concat(root, content)))


def turn_symbol(role: Column, text: Column) -> Column:
    """16 bytes of hash of (role, text), then the text's length in code points as 8 bytes."""
    size = F.lpad(F.hex(F.char_length(text).cast("long")), 16, "0")
    return F.unhex(F.concat(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), size))


def _text_size(symbol: Column) -> Column:
    return F.conv(F.hex(F.substring(symbol, 17, 8)), 16, 10).cast("long")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, piece, at, symbol): the turns of ``turns`` (conv_id, turn, role, text), numbered within each piece of a
    conversation.

    Order: turn (null first), then the hash of role and text. A conversation is cut into ranges of turns, so one that
    holds a third of all rows spans many tasks; copies of a row may be parted too.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        turn_symbol(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("symbol"),
        F.monotonically_increasing_id().alias("copy"))
    order = [F.col("turn").asc_nulls_first(), "symbol", "copy"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(n, "conv", *order).withColumn("piece", F.spark_partition_id()), "turns")
    at = F.row_number().over(Window.partitionBy("conv", "piece").orderBy(*order))
    return ranged.select("conv", "piece", at.cast("long").alias("at"), "symbol")


def rebuilt_sequences(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Sequences of rebuilt conversations: (conv, at from 0, content, size) and (conv, size) of every conversation.

    Conversation c starts with the first h original turns of conversation c - c % ``group`` (all if it has fewer, none
    if it is absent) and goes on with its own turns after its first h; h = crc32(c in decimal) % ``most``. Rows without
    conversation id take no part; a null role or text is empty.
    """
    rows = stage(numbered_turns(turns), "numbered")
    pieces = rows.groupBy("conv", "piece").agg(F.max("at").alias("n"))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stage(pieces.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "pieces")
    sizes = pieces.groupBy("conv").agg(F.sum("n").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    asked = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = (asked.join(base, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
             .withColumn("size", F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h"))))
    convs = stage(convs.select("conv", "base", "h", "lent", "size"), "rebuilt-sizes")
    placed = rows.join(pieces.join(convs, "conv").select("conv", "piece", "first", "h", "lent", "size"), ["conv", "piece"])
    placed = placed.withColumn("at", F.col("first") + F.col("at"))
    own = placed.where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("lent") - 1).alias("at"),
                                        F.col("symbol").alias("content"), "size")
    heads = placed.where((F.col("conv") % group == 0) & (F.col("at") < most)).select(F.col("conv").alias("base"), "at", "symbol")
    lent = (convs.where("lent > 0").join(heads, "base").where("at <= lent")
            .select("conv", (F.col("at") - 1).alias("at"), F.col("symbol").alias("content"), "size"))
    return stage(own.unionByName(lent), "sequences"), convs.select("conv", "size")


def blocks(seqs: DataFrame, levels: int) -> list[DataFrame]:
    """Hashes of the aligned blocks of each sequence: at level k (conv, at, size, content, left, right) for 2^k turns.

    A block without a right half has the hash of its left one. A sequence leaves when one block holds it whole.
    """
    out = [seqs.select("conv", "at", "size", "content")]
    for k in range(1, levels + 1):
        even = F.col("at") % 2 == 0
        half = out[-1].where(F.col("size") > (1 << (k - 1)))
        pairs = half.groupBy("conv", F.floor(F.col("at") / 2).alias("at")).agg(
            F.max("size").alias("size"), F.max(F.when(even, F.col("content"))).alias("left"),
            F.max(F.when(~even, F.col("content"))).alias("right"))
        content = F.coalesce(_name(F.col("left"), F.col("right")), F.col("left"))
        out.append(stage(pairs.select("conv", "at", "size", content.alias("content"), "left", "right"), f"blocks-{k}"))
    return out


def whole_sequences(levels: list[DataFrame]) -> DataFrame:
    """(conv, size, content) of every sequence of one turn and more."""
    whole = None
    for k, rows in enumerate(levels):
        least = 0 if k == 0 else 1 << (k - 1)
        found = rows.where((F.col("at") == 0) & (F.col("size") > least) & (F.col("size") <= (1 << k)))
        found = found.select("conv", "size", "content")
        whole = found if whole is None else whole.unionByName(found)
    return whole


_ITEM = ["root", "start", "left", "content", "conv", "weight", "ends", "below"]


def _cut(whole: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Cut all problems level by level: (items of one turn, split items by level, upper items by level)."""
    none = F.lit(None).cast("binary")
    top = len(levels) - 1
    start = whole.groupBy("size", "content").agg(F.min("conv").alias("conv"), F.count("conv").alias("weight"))
    start = stage(start.select(F.lit(ROOT).alias("root"), F.lit(0).cast("long").alias("start"), F.col("size").alias("left"),
                               "content", "conv", "weight", F.col("content").alias("ends"), none.alias("below")), "items")
    waiting = [(top + 1, start)]  # (level that made them, items of any length up to 2^(level - 1))
    uppers: list[DataFrame] = [None] * (top + 2)
    splits: list[DataFrame] = [None] * (top + 2)

    def live(k: int) -> DataFrame:
        """The items of more than 2^(k-1) and at most 2^k turns. Full ones of earlier levels are among the upper items."""
        least, most = (1 << k) // 2, 1 << k
        found = uppers[k + 1]
        for made, items in waiting:
            part = items.where((F.col("left") > least) & (F.col("left") <= (most if made == k + 1 else most - 1)))
            found = part if found is None else found.unionByName(part)
        return found

    for k in range(top, 0, -1):
        half = 1 << (k - 1)
        halves = levels[k].where(F.col("right").isNotNull()).select(
            "conv", (F.col("at") * (1 << k)).alias("start"), F.col("left").alias("first"), F.col("right").alias("second"))
        split = live(k).join(halves, ["conv", "start"]).withColumn("cut", _name(F.col("root"), F.col("first")))
        splits[k] = split = stage(split.withColumn("name", _name(F.col("root"), F.col("content"))), f"split-{k}")
        upper = split.select("root", "start", F.lit(half).cast("long").alias("left"), F.col("first").alias("content"), "conv",
                             "weight", none.alias("ends"), F.col("cut").alias("below"))
        for _, items in waiting:  # items that end at the cut are prefixes of the split ones
            upper = upper.unionByName(items.where(F.col("left") == half))
        uppers[k] = stage(upper.groupBy("root", "start", "left", "content").agg(
            F.min("conv").alias("conv"), F.sum("weight").alias("weight"), F.max("ends").alias("ends"),
            F.max("below").alias("below")).select(*_ITEM), f"upper-{k}")
        waiting.append((k, split.select(F.col("cut").alias("root"), (F.col("start") + half).alias("start"),
                                        (F.col("left") - half).alias("left"), F.col("second").alias("content"), "conv",
                                        "weight", "ends", "below")))
    return live(0), splits, uppers


def _graft(sums: DataFrame, uppers: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Sums of each problem grafted onto its upper trie, level by level: (sums below the root, forest sums by level).

    ``sums``: (root, leaves, saved) of the nodes right below each prefix.
    """
    forests: list[DataFrame] = [None]
    for k, upper in enumerate(uppers[1:-1], 1):
        cuts = upper.where(F.col("below").isNotNull()).select(F.col("below").alias("root"), F.col("root").alias("above"))
        met = stage(sums.join(cuts, "root", "left"), f"forests-{k}")
        forests.append(met.where(F.col("above").isNotNull()).select(F.col("root").alias("name"), *_SUMS))
        sums = met.groupBy(F.coalesce("above", "root").alias("root")).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return sums, forests


def _spread(forests: list[DataFrame], splits: list[DataFrame]) -> DataFrame | None:
    """(name, leaves, saved): what lower forests add to the items of one turn; the sum of a forest goes to the item
    that ends at its cut, and what an item gets goes on to both halves."""
    due = None
    for k in range(len(forests) - 1, 0, -1):
        found = forests[k]
        if due is not None:
            halves = F.array("cut", _name(F.col("cut"), F.col("second")))
            parts = splits[k].select("name", halves.alias("halves"))
            passed = due.join(parts, "name", "left")
            found = found.unionByName(passed.select(
                F.explode(F.coalesce("halves", F.array("name"))).alias("name"), *_SUMS))
        due = stage(found.groupBy("name").agg(*[F.sum(c).alias(c) for c in _SUMS]), f"due-{k}")
    return due


def ends_digest(members: DataFrame) -> DataFrame:
    """(ends, ends_sha256): SHA-256 of the decimal ids of ``members`` (ends, conv), ascending, joined by commas.

    Runs of at most 2^IDS ids are joined in parallel; the hash of a group then reads its runs one after the other.
    """
    runs = (members.groupBy("ends", F.shiftright("conv", IDS).alias("run"))
            .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    dealt = runs.repartition("ends").sortWithinPartitions("ends", "run").select("ends", "ids")

    def digest(batches):
        key, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for ends, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ends != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = ends, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _pairs(done)
        if state is not None:
            yield _pairs([(key, state.hexdigest())])

    return dealt.mapInArrow(digest, "ends binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.string())],
                                      ["ends", "ends_sha256"])


@dataclass
class Trie:
    """``nodes``: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends.

    ``members``: (ends, conv) for every conversation; a node's ``ends`` is null where no conversation ends.
    """
    nodes: DataFrame
    members: DataFrame


def prefix_trie(seqs: DataFrame, convs: DataFrame) -> Trie:
    """Trie of the sequences ``seqs`` (conv, at from 0, content, size); ``convs`` (conv, size) names all conversations,
    those without turns included. Without any conversation the trie has no node, not even the root."""
    spark = seqs.sparkSession
    out = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
           "ends binary")
    known = convs.agg(F.count("conv").alias("n"), F.min("conv").alias("least"), F.max("size").alias("depth")).first()
    if not known["n"]:
        return Trie(spark.createDataFrame([], out), spark.createDataFrame([], "ends binary, conv long"))
    levels = blocks(seqs, (max(known["depth"], 1) - 1).bit_length())
    whole = stage(whole_sequences(levels), "whole")
    items, splits, uppers = _cut(whole, levels)
    edges = stage(items.withColumn("name", _name(F.col("root"), F.col("content"))).withColumn(
        "leaves", F.col("below").isNull().cast("long")).withColumn(
        "saved", (F.col("weight") - 1) * _text_size(F.col("content"))), "edges")
    kids = edges.groupBy("root").agg(F.count("name").alias("n_children"), *[F.sum(c).alias(c) for c in _SUMS])
    kids = stage(kids, "children")
    sums, forests = _graft(kids.select("root", *_SUMS), uppers)
    due = _spread(forests, splits)
    if due is None:
        due = spark.createDataFrame([], "name binary, leaves long, saved long")
    more = due.select("name", *[F.col(c).alias(f"more_{c}") for c in _SUMS])
    children = kids.select(F.col("root").alias("below"), "n_children")
    nodes = stage(edges.join(more, "name", "left").join(children, "below", "left").select(
        "root", "below", "conv", (F.col("start") + 1).alias("depth"), F.col("weight").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _SUMS], "ends"), "nodes")

    # each node meets its parent: the parents of many children by broadcast, the others by a join
    total = nodes.count()
    parents = nodes.where("n_children > 0").select(F.col("below").alias("root"), F.col("conv").alias("above"),
                                                   (F.col("n_children") * HEAVY > total).alias("heavy"))
    heavy = stage(parents.where("heavy").select("root", "above"), "heavy-parents")
    light = parents.where("not heavy").select("root", "above")
    first = nodes.where(F.col("root") == F.lit(ROOT)).withColumn("above", F.lit(known["least"]))
    rest = nodes.where(F.col("root") != F.lit(ROOT))
    below = rest.join(F.broadcast(heavy), "root").unionByName(
        rest.join(F.broadcast(heavy), "root", "left_anti").join(light, "root"))
    found = first.unionByName(below).select(
        F.col("conv").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")
    below_root = sums.where(F.col("root") == F.lit(ROOT)).first()
    n_first = kids.where(F.col("root") == F.lit(ROOT)).first()
    root = spark.createDataFrame([(known["least"], 0, None, known["n"], n_first["n_children"] if n_first else 0,
                                   below_root["leaves"] if below_root else 1, below_root["saved"] if below_root else 0,
                                   ROOT)], out)
    turnless = convs.where("size = 0").select(F.lit(ROOT).alias("ends"), "conv")
    return Trie(root.unionByName(found), whole.select(F.col("content").alias("ends"), "conv").unionByName(turnless))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, with the digest of the conversations that end at each."""
    trie = prefix_trie(*rebuilt_sequences(turns))
    digests = ends_digest(trie.members)
    nothing = hashlib.sha256(b"").hexdigest()
    return (trie.nodes.join(digests, "ends", "left").drop("ends")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing))))
