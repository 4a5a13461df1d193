"""Language-model scoring by prediction by partial matching (PPM) over bytes, beside a smoothed word unigram.

A text is its lower-cased words, each followed by a space, then an end symbol. Every symbol is coded in the longest
context (up to ``ORDER`` bytes) that the training texts hold; an escape (method D) leads to the next shorter context,
where the symbols of the longer one are excluded; below order 0 the remaining symbols are equally likely. The code
lengths are pretrained: counts come from the whole training part of the table.

Nothing that grows with the corpus is broadcast. Documents are packed into blocks of about ``BLOCK_BYTES`` of text;
each block reports its distinct words and symbol contexts with their training counts, split by hash into buckets. A
bucket adds the counts of all blocks, works out the log-probability of each distinct (context, symbol) and answers
each block in the order of its question; the block's texts are then scored from the answers. Contexts are bucketed by
their last two bytes, so all longer contexts that a code needs lie in the same bucket; orders 0 and 1 (at most 65,536
counts) are shared with all buckets.

Null and empty texts hold the end symbol only. A null id is never held out. Words are told apart by 63-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lower_bytes, mix64, segment_ids, span_hashes, stage, text_slices, word_bounds

ORDER = 6
BLOCK_BYTES = 24 << 20
SLICE = 1 << 20  # text handled at once
MERGE = 1_500_000  # dictionary entries that are kept before they are merged
PAD, END = 0xFF, 0xFE  # bytes that UTF-8 never holds
ALPHABET = 256
WORD, GRAM = 0, 1
_END_WORD = np.uint64(0)


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def _expand(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _pack_sorted(codes: np.ndarray) -> bytes:
    return _squeeze(np.diff(codes, prepend=codes.dtype.type(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_expand(blob, "<u8"), dtype=np.uint64)


def _symbols(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of each text of a slice, behind ORDER pads, and the bounds of the texts."""
    size, n = ends - starts, len(offsets) - 1
    first = np.searchsorted(starts, offsets)
    grown = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=grown[1:])
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(np.diff(grown[first]) + ORDER + 1, out=bounds[1:])
    out = np.full(bounds[-1], PAD, np.uint8)
    at = grown[:-1] + np.repeat(bounds[:-1] + ORDER - grown[first[:-1]], np.diff(first))
    inside = np.arange(size.sum(), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + inside] = data[np.repeat(starts, size) + inside]
    out[at + size] = 32
    out[bounds[1:] - 1] = END
    return out, bounds


def _codes(symbols: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """(context, symbol) of each coded byte, packed into one integer."""
    out = np.zeros(len(symbols) - ORDER, np.uint64)
    for i in range(ORDER - order, ORDER + 1):
        out <<= np.uint64(8)
        out |= symbols[i:len(symbols) - ORDER + i]
    coded = np.ones(len(symbols), bool)
    for i in range(ORDER):
        coded[bounds[:-1] + i] = False
    return out[coded[ORDER:]]


def _parts(data: bytes, offsets: np.ndarray, max_bytes: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) of slices of a block."""
    flat, lo = np.frombuffer(data, np.uint8), 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, lo + 20_000)
        yield lo, lower_bytes(flat[offsets[lo]:offsets[hi]]), offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def _add(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def pack_blocks(docs: DataFrame) -> DataFrame:
    """(b, ids, train, offsets, data, pairs): runs of whole documents (doc_id, train, text) as compressed blocks.

    ``pairs`` holds the training counts of order 1. Block ids are made up of the partition and a running number, and
    are settled when the result is stored.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext
        task, made = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        train: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        data: list[bytes] = []
        pairs = np.zeros(1 << 16, np.int64)

        def flush():
            nonlocal made, pairs
            block = pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + made], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                 pa.array([np.concatenate(train).tobytes()], pa.binary()),
                 pa.array([_squeeze(np.concatenate(sizes))], pa.binary()),
                 pa.array([zstandard.ZstdCompressor(3).compress(b"".join(data))], pa.binary()),
                 pa.array([_squeeze(pairs)], pa.binary())], ["b", "ids", "train", "sizes", "data", "pairs"])
            made += 1
            for x in (ids, train, sizes, data):
                x.clear()
            pairs = np.zeros(1 << 16, np.int64)
            return block

        for rows, flat, offsets in text_slices(batches, SLICE):
            ids.append(rows.column(0))
            flag = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
            train.append(flag)
            sizes.append(np.diff(offsets))
            data.append(flat.tobytes())
            low = lower_bytes(flat)
            symbols, bounds = _symbols(low, offsets, *word_bounds(low, offsets))
            learned = np.repeat(flag, np.diff(bounds) - ORDER)
            pairs += np.bincount(_codes(symbols, bounds, 1)[learned].astype(np.int64), minlength=1 << 16)
            if sum(map(len, data)) >= BLOCK_BYTES:
                yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "train", "text").mapInArrow(
        run, f"b long, ids array<{kind}>, train binary, sizes binary, data binary, pairs binary")


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, bytes]:
    offsets = np.concatenate([[0], np.cumsum(_expand(row["sizes"], "<i8"))])
    return np.frombuffer(row["train"], bool), offsets, zstandard.ZstdDecompressor().decompress(row["data"])


def _bucket_of(kind: int, codes: np.ndarray, n: int) -> np.ndarray:
    key = codes if kind == WORD else (codes >> np.uint64(8)) & np.uint64(0xFFFF)
    return (mix64(key + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def _word_codes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (span_hashes(low, starts, ends) >> np.uint64(1)) | np.uint64(1)


def _dictionary(row: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct word and gram codes of a block, in order, with their training counts."""
    train, offsets, data = _block(row)
    got: dict[int, list] = {WORD: [(np.array([_END_WORD]), np.array([train.sum()], np.int64))], GRAM: []}
    for lo, low, off in _parts(data, offsets):
        flag = train[lo:lo + len(off) - 1]
        starts, ends = word_bounds(low, off)
        symbols, bounds = _symbols(low, off, starts, ends)
        for kind, codes, of in ((WORD, _word_codes(low, starts, ends), segment_ids(off, starts)),
                                (GRAM, _codes(symbols, bounds), np.repeat(np.arange(len(flag)), np.diff(bounds) - ORDER))):
            learned = flag[of]
            known, n = np.unique(codes[learned], return_counts=True)
            other = np.unique(codes[~learned])
            got[kind].append((np.concatenate([known, other]), np.concatenate([n, np.zeros(len(other), np.int64)])))
            if sum(len(x) for x, _ in got[kind][1:]) > MERGE:
                got[kind] = [_merged(got[kind])]
    return {k: _merged(v) for k, v in got.items()}


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _add(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """(kind, r, b, codes, counts): each block's dictionary, one row a bucket."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (codes, counts) in _dictionary(row).items():
                    r = _bucket_of(kind, codes, buckets)
                    order = np.argsort(r, kind="stable")
                    cuts = np.searchsorted(r[order], np.arange(buckets + 1))
                    out = [(kind, i, row["b"], _pack_sorted(codes[order[a:z]]), _squeeze(counts[order[a:z]]))
                           for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                            pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        ["kind", "r", "b", "codes", "counts"])

    return blocks.select("b", "train", "sizes", "data").mapInArrow(
        run, "kind int, r int, b long, codes binary, counts binary")


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], 0)


class _Trie:
    """Counts of one order: (context, symbol) codes, and totals and distinct symbols of each context."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, self.n = codes, n
        context = codes >> np.uint64(8)
        self.first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(codes) else np.zeros(0, np.int64)
        self.context = context[self.first]
        self.total = np.add.reduceat(n, self.first) if len(codes) else n
        self.distinct = np.diff(np.append(self.first, len(codes)))


def code_lengths(wanted: np.ndarray, codes: np.ndarray, n: np.ndarray, pairs: np.ndarray, order: int = ORDER
                 ) -> np.ndarray:
    """log10 probability of each wanted (context, symbol) code.

    ``codes`` and ``n`` are the training counts of order ``order`` for all contexts that end in the last two bytes of a
    wanted one; ``pairs`` are those of order 1 for all contexts.
    """
    tries = {order: _Trie(codes, n)}
    for j in range(order - 1, 1, -1):
        t = tries[j + 1]
        tries[j] = _Trie(*_add(t.codes & np.uint64((1 << 8 * (j + 1)) - 1), t.n))
    seen = np.flatnonzero(pairs).astype(np.uint64)
    tries[1] = _Trie(seen, pairs[seen.astype(np.int64)])
    single = pairs.reshape(256, 256).sum(0)
    seen = np.flatnonzero(single).astype(np.uint64)
    tries[0] = _Trie(seen, single[seen.astype(np.int64)])
    out = np.zeros(len(wanted))
    left = np.ones(len(wanted), bool)
    gone_total = np.zeros(len(wanted), np.int64)  # counts and number of the symbols that the longer context excludes
    gone = np.zeros(len(wanted), np.int64)
    for j in range(order, -1, -1):
        t = tries[j]
        code = wanted & np.uint64((1 << 8 * (j + 1)) - 1)
        known, total = _find(t.context, t.total, code >> np.uint64(8))
        _, distinct = _find(t.context, t.distinct, code >> np.uint64(8))
        here, count = _find(t.codes, t.n, code)
        rest = 2 * (total - gone_total)
        hit = left & here
        out[hit] += np.log10((2 * count[hit] - 1) / rest[hit])
        escape = left & known & ~here & (distinct > gone)
        out[escape] += np.log10((distinct - gone)[escape] / rest[escape])
        left &= ~hit
        if j and len(t.codes):
            _, below = _find(tries[j - 1].codes, tries[j - 1].n, t.codes & np.uint64((1 << 8 * j) - 1))
            _, gone_total = _find(t.context, np.add.reduceat(below, t.first), code >> np.uint64(8))
            gone = distinct
    out[left] -= np.log10(max(1, ALPHABET - len(tries[0].codes)))
    return out


def answer(asked: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(b, kind, r, values, tokens, words): counts of words and log10 probabilities of grams for each block's question.

    Rows without a block hold the training tokens and distinct training words of a bucket.
    """
    names = ["b", "kind", "r", "values", "tokens", "words"]
    shared = asked.sparkSession.sparkContext.broadcast(pairs)  # 65,536 numbers

    def run(group: pa.Table) -> pa.Table:
        kind, r = group["kind"][0].as_py(), group["r"][0].as_py()
        lists = [_unpack_sorted(x) for x in group["codes"].to_pylist()]
        codes, total = _add(np.concatenate(lists), np.concatenate(
            [_expand(x, "<i8") for x in group["counts"].to_pylist()]))
        learned = total > 0
        if kind == GRAM:
            values = code_lengths(codes, codes[learned], total[learned], shared.value).astype("<f4")
        else:
            values = total.astype("<i8")
        rows = [(b, kind, r, _squeeze(values[np.searchsorted(codes, x)]), None, None)
                for b, x in zip(group["b"].to_pylist(), lists, strict=True)]
        if kind == WORD:
            rows.append((None, kind, r, None, int(total.sum()), int(learned.sum())))
        return pa.table({k: pa.array(c, t) for k, c, t in zip(names, zip(*rows, strict=True), (
            pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)})

    return asked.groupBy("kind", "r").applyInArrow(
        run, "b long, kind int, r int, values binary, tokens long, words long")


def _score_block(row: dict, answers: dict[tuple[int, int], np.ndarray], buckets: int):
    train, offsets, data = _block(row)
    dictionary = _dictionary(row)
    values = {}
    for kind, (codes, _) in dictionary.items():
        r = _bucket_of(kind, codes, buckets)
        order = np.argsort(r, kind="stable")
        cuts = np.searchsorted(r[order], np.arange(buckets + 1))
        out = np.zeros(len(codes), "<f8" if kind == GRAM else "<i8")
        for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if z > a:
                out[order[a:z]] = answers[kind, i]
        values[kind] = out
    n = len(train)
    end = values[WORD][0]  # the end's code is the smallest
    tokens, known = np.ones(n, np.int64), np.full(n, int(end > 0), np.int64)
    base, score = np.full(n, np.log10(end + 0.1)), np.zeros(n)
    for lo, low, off in _parts(data, offsets):
        starts, ends = word_bounds(low, off)
        symbols, bounds = _symbols(low, off, starts, ends)
        words, again = np.unique(_word_codes(low, starts, ends), return_inverse=True)
        count = _find(dictionary[WORD][0], values[WORD], words)[1][again]
        of, m = segment_ids(off, starts), len(off) - 1
        tokens[lo:lo + m] += np.bincount(of, minlength=m)
        known[lo:lo + m] += np.bincount(of, count > 0, minlength=m).astype(np.int64)
        base[lo:lo + m] += np.bincount(of, np.log10(count + 0.1), minlength=m)
        grams, again = np.unique(_codes(symbols, bounds), return_inverse=True)
        coded = np.diff(bounds) - ORDER
        score[lo:lo + m] = np.add.reduceat(_find(dictionary[GRAM][0], values[GRAM], grams)[1][again],
                                           np.cumsum(coded) - coded)
    return tokens, known, base, score


def ppm_scores(docs: DataFrame, held: int = 0, of: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Rows whose id's crc32 remainder is ``held`` are not learned from. ``base_score`` is the sum over tokens (words and
    one end) of log10((c + 0.1) / (N + 0.1 (V + 1))).
    """
    remainder = crc_mod(F.col("doc_id"), of)
    rows = docs.select("doc_id", F.coalesce(remainder != held, F.lit(True)).alias("train"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    blocks = stage(pack_blocks(rows), "blocks")

    def add(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += _expand(blob, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["pairs"])

    parts = blocks.select("pairs").mapInArrow(add, "pairs binary")
    pairs = parts.rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64)).treeReduce(np.add, depth=3)
    n_blocks = blocks.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks // 8)
    answers = stage(answer(ask(blocks, buckets), pairs), "answers")

    def score(key, own: pa.Table, got: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "base", "score"]
        if not own.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, (
                own.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        values = {(k, r): _expand(v, "<f4" if k == GRAM else "<i8") for k, r, v in zip(
            got["kind"].to_pylist(), got["r"].to_pylist(), got["values"].to_pylist(), strict=True)}
        made = _score_block({k: own[k][0].as_py() for k in ("train", "sizes", "data")}, values, buckets)
        ids = own["ids"].combine_chunks().flatten()
        return pa.table(dict(zip(names, [ids, *map(pa.array, made)], strict=True)))

    scored = (blocks.select("b", "ids", "train", "sizes", "data").groupBy("b")
              .cogroup(answers.where("b is not null").select("b", "kind", "r", "values").groupBy("b"))
              .applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base double, score double"))
    size = answers.where("b is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"),
                                          F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    n, v = size["n"], size["v"]
    return scored.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), of) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(n + 0.1 * (v + 1)))).alias("base_score"), "score")
