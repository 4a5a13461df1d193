"""SentencePiece models on the tokenizers library: parse the model file, rebuild it, encode and decode, check parity.

``parse_model`` reads the protobuf wire format; ``build_tokenizer`` rebuilds the normaliser, the metaspace marker, the
piece scores (unigram) or the merges they imply (BPE) and byte fallback. ``encode_texts`` encodes and decodes whole
texts of a DataFrame: each task cuts its texts at word bounds that no piece crosses (checked against the model),
encodes every distinct cut once with a multithreaded batch call, puts the ids together again, and compares them with
what the sentencepiece library makes of the whole text. A null text has null ids and counts as equal; an empty text has
no ids.
"""

from __future__ import annotations

import hashlib
import os
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import give_back, span_hashes, text_slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
UNIGRAM, BPE = 1, 2
CACHE = 1_000_000  # distinct cuts that a task remembers before it starts afresh
JOINED = 2000  # cuts to a text of a batch call


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            if kind == 2:
                size, i = _varint(b, i)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a model file")
            value, i = b[i:i + size], i + size
        yield key >> 3, value


@dataclass
class PieceModel:
    raw: bytes
    pieces: list[tuple[str, float, int]]  # text, score, kind
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True
    charsmap: bytes = b""

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def crossing(self) -> bool:
        """Whether some piece holds a marker after another character, or a line break beside one."""
        return any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1)
                   for p, _, kind in self.pieces if kind in (NORMAL, USER))


def parse_model(raw: bytes) -> PieceModel:
    m = PieceModel(raw, [])
    for field, value in _fields(raw):
        if field == 1:
            x = dict(_fields(value))
            m.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
        elif field == 2:
            x = dict(_fields(value))
            m.model_type, m.byte_fallback = x.get(3, UNIGRAM), bool(x.get(35, 0))
        elif field == 3:
            x = dict(_fields(value))
            m.charsmap = x.get(2, b"")
            m.dummy_prefix, m.collapse_spaces = bool(x.get(3, 1)), bool(x.get(4, 1))
            m.escape_spaces = bool(x.get(5, 1))
    return m


def _merges(m: PieceModel) -> list[tuple[str, str]]:
    """Every pair of pieces that makes a piece, best score first."""
    scores = {p: s for p, s, kind in m.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in scores and right in scores:
                found.append((-score, len(found), left, right))
    return [(a, b) for _, _, a, b in sorted(found)]


def build_tokenizer(m: PieceModel, prefix: bool = True) -> Tokenizer:
    """The model as a tokenizers pipeline; without ``prefix`` no marker is put before the text."""
    if m.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    elif m.model_type == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m), unk_token=m.pieces[m.unk_id][0],
                          fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type} is not supported")
    t = Tokenizer(core)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.collapse_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(undo + [decoders.Strip(" ", 1, 0)] if m.dummy_prefix and prefix else undo)
    return t


class Codec:
    """Encodes and decodes slices of texts; lives in a task."""

    def __init__(self, raw: bytes, parity: bool = True, threads: int | None = None):
        import sentencepiece
        # the executor's cores bound the threads of a batch call
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads or 2))
        self.model = parse_model(raw)
        # without byte fallback a run of unknown characters is one token, which a cut would part
        self.cuts = self.model.byte_fallback and not (self.model.crossing or self.model.charsmap or self.model.collapse_spaces)
        self.cut_tokenizer = build_tokenizer(self.model, prefix=not self.cuts)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw) if parity else None
        self.prefix = self.cuts and self.model.dummy_prefix
        line = self.cut_tokenizer.encode("\n").ids if self.cuts else []
        # a line break must be a token of its own, not one that stands for other characters as well
        alone = len(line) == 1 and self.model.pieces[line[0]][::2] in (("\n", NORMAL), ("\n", USER), ("<0x0A>", BYTE))
        self.line = line[0] if alone else None
        # the bytes that each id stands for
        spelled = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode()
                   for p, _, kind in self.model.pieces]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each cut. Cuts travel joined by line breaks, which are a token of their own, in a threaded batch."""
        if self.line is None:
            return [np.array(e.ids, np.int32) for e in self.cut_tokenizer.encode_batch(texts, add_special_tokens=False)]
        blocks = [texts[i:i + JOINED] for i in range(0, len(texts), JOINED)]
        out: list[np.ndarray] = []
        for e in self.cut_tokenizer.encode_batch_fast(["\n".join(b) for b in blocks], add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            at = np.flatnonzero(ids == self.line)
            starts, ends = np.append(0, at + 1), np.append(at, len(ids))
            out += [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    def learn(self, hashes: np.ndarray, cuts: list[bytes]) -> None:
        texts = [c.decode("utf-8", "replace") for c in cuts]
        breaks = [i for i, c in enumerate(cuts) if c == b"\n" and self.line is not None]
        for i in reversed(breaks):  # at most one, as the cuts are distinct
            texts.pop(i)
        ids = self.batch(texts) if texts else []
        for i in breaks:
            texts.insert(i, "\n")
            ids.insert(i, np.array([self.line], np.int32))
        base = len(self.at) - 1
        self.known.update(zip(hashes.tolist(), range(base, base + len(ids)), strict=True))
        self.flat = np.concatenate([self.flat, *ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def agrees(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the sentencepiece library, with the model as given, makes the same ids of each whole text."""
        same = np.ones(len(offsets) - 1, bool)
        if self.reference:
            raw = data.tobytes()
            for i in range(len(same)):
                whole = self.reference.encode(raw[offsets[i]:offsets[i + 1]].decode("utf-8", "replace"))
                same[i] = ids[at[i]:at[i + 1]].tolist() == whole
        return same

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, id offsets, equal to the reference, decoded text equals the text) of each text of a slice."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        if self.prefix:  # one space before each text that is not empty stands for the marker
            grown = np.zeros(n + 1, np.int64)
            np.cumsum(sizes + (sizes > 0), out=grown[1:])
            body = np.full(grown[-1], 32, np.uint8)
            keep = np.ones(grown[-1], bool)
            keep[grown[:-1][sizes > 0]] = False
            body[keep] = data
        else:
            body, grown = data, offsets
        first = np.zeros(len(body) + 1, bool)
        first[grown[:-1]] = True
        if self.cuts and len(body):
            space, line = body == 32, body == 10
            after = space.copy()  # the last byte of a marker: a space, or U+2581 in the text
            after[2:] |= (body[:-2] == 0xE2) & (body[1:-1] == 0x96) & (body[2:] == 0x81)
            first[1:-1] |= (space[1:] & ~after[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(first[:-1])
        ends = np.append(starts[1:], len(body))
        h = span_hashes(body, starts, ends)
        uniq, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > CACHE:
            self.forget()
        fresh = [i for i, x in enumerate(uniq.tolist()) if x not in self.known]
        if fresh:
            raw = body.tobytes()
            self.learn(uniq[fresh], [raw[starts[where[i]]:ends[where[i]]] for i in fresh])
        slot = np.fromiter((self.known[x] for x in uniq.tolist()), np.int64, len(uniq))[inverse]
        text_of = np.searchsorted(starts, grown)
        ids, id_at = _gather(self.flat, self.at, slot)
        back, back_at = _gather(self.spelled, self.spelled_at, ids)
        same = self.agrees(data, offsets, ids, id_at[text_of])
        whole = back_at[id_at[text_of]]
        wrong = np.diff(whole) != np.diff(grown)
        if wrong.any():  # lengths differ: compare text by text
            for i in np.flatnonzero(~wrong):
                wrong[i] = not np.array_equal(back[whole[i]:whole[i + 1]], body[grown[i]:grown[i + 1]])
        else:
            bad = np.zeros(len(body) + 1, np.int64)
            np.cumsum(back != body, out=bad[1:])
            wrong = bad[grown[1:]] != bad[grown[:-1]]
        return ids, id_at[text_of], same, ~wrong


@lru_cache(maxsize=1)
def _codec(raw: bytes, parity: bool) -> Codec:
    """One codec per worker process; tasks that follow find the model parsed."""
    return Codec(raw, parity)


def _gather(flat: np.ndarray, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``slot`` of a flat array; returns it with the bounds of the runs."""
    size = at[slot + 1] - at[slot]
    out = np.zeros(len(slot) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    index = np.arange(out[-1], dtype=np.int64) + np.repeat(at[slot] - out[:-1], size)
    return flat[index], out


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, raw_model: bytes, text: str = "text", ids: bool = True, parity: bool = True
                 ) -> DataFrame:
    """All columns of ``docs`` but the text, plus ``ids`` (array<int>, if asked for), ``n_tokens``, ``n_bytes_tokens``
    (byte-fallback tokens), ``ids_sha256`` (of the ids as little-endian 32-bit integers), ``parity`` (the sentencepiece
    library gives the same ids for the whole text) and ``round_trip`` (the decoded ids are the text).
    """
    rest = [c for c in docs.columns if c != text]
    added = ["n_tokens", "n_byte_tokens", "ids_sha256", "parity", "round_trip"] + ["ids"] * ids
    clash = set(rest) & set(added)
    rows = docs.select(*[F.col(c).alias(f"_own_{c}" if c in clash else c) for c in rest], F.col(text).alias("_text"))
    kinds = [f"`{c}` {k}" for c, k in rows.dtypes[:-1]]
    schema = ", ".join([*kinds, "n_tokens long, n_byte_tokens long, ids_sha256 string, parity boolean, "
                        "round_trip boolean" + ", ids array<int>" * ids])

    def run(batches):
        codec = _codec(raw_model, parity)
        is_byte = np.array([k == BYTE for _, _, k in codec.model.pieces])
        for batch, data, offsets in text_slices(batches, 2 << 20, "_text"):
            flat, at, same, whole = codec.encode(data, offsets)
            fallback = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(is_byte[flat], out=fallback[1:])
            raw, n = flat.astype("<i4").tobytes(), len(at) - 1
            null = batch.column(batch.num_columns - 1).is_null().to_numpy(zero_copy_only=False)
            out = [pa.array(np.diff(at), mask=null), pa.array(fallback[at[1:]] - fallback[at[:-1]], mask=null),
                   pa.array([None if null[i] else hashlib.sha256(raw[4 * at[i]:4 * at[i + 1]]).hexdigest()
                             for i in range(n)], pa.string()),
                   pa.array(same), pa.array(whole)]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null, False)),
                                                    pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], *added])
        codec.forget()
        give_back()

    return rows.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, raw_model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """Replace the ids by the text they stand for (null ids: null text)."""
    rest = [c for c in rows.columns if c != ids]
    kinds = dict(rows.dtypes)

    def run(batches):
        tokenizer = build_tokenizer(parse_model(raw_model))
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = iter(tokenizer.decode_batch([x for x in lists if x is not None], skip_special_tokens=False))
            column = pa.array([None if x is None else next(texts) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*rest, out])

    return rows.select(*rest, ids).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{out}` string"]))
