"""The unigram path of the SentencePiece codec: a model written by hand, against the sentencepiece library."""

import struct

import numpy as np
import pytest

from papyra.llm.sentencepieces import BYTE, CONTROL, MARK, NORMAL, UNIGRAM, UNKNOWN, USER, Codec, decode_ids, encode_texts, parse_model

from .helpers import odd_docs


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _field(number, value):
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def unigram_model(byte_fallback=True, dummy_prefix=True, collapse=False):
    """A model of words, parts and letters whose scores decide between several cuts of a word."""
    words = {MARK: -4.0, f"{MARK}the": -2.0, "the": -3.5, f"{MARK}th": -4.5, "e": -3.0, "er": -3.2, f"{MARK}there": -5.9, "re": -3.1,
             "a": -5.0, "b": -5.1, "c": -5.2, "ab": -7.0, "abc": -14.0, "bc": -6.0, f"{MARK}a": -4.1, "é": -6.0, "日本": -8.0,
             ".": -4.0, "t": -6.2, "h": -6.3, "r": -6.4, f"{MARK}b": -9.0}
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL), ("<mask>", 0.0, USER)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    pieces += [(w, s, NORMAL) for w, s in words.items()]
    raw = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    trainer = _field(3, UNIGRAM) + _field(35, int(byte_fallback)) + _field(40, 0) + _field(41, 1) + _field(42, 2) + _field(43, 2 ** 64 - 1)
    normalizer = _field(1, b"identity") + _field(3, int(dummy_prefix)) + _field(4, int(collapse)) + _field(5, 1)
    return raw + _field(2, trainer) + _field(3, normalizer)


TEXTS = ["the there a abc", "there", "", " ", "  the  a ", "the\nthere\n\na", "xyz qé 日本語 \U0001F600", "ab.abc. bc", "the" * 300, "ther e", "a" * 200]


@pytest.mark.parametrize("options", [{}, {"dummy_prefix": False}, {"byte_fallback": False}, {"collapse": True}])
def test_unigram_ids_equal_the_library(options):
    import sentencepiece
    raw = unigram_model(**options)
    model = parse_model(raw)
    assert model.model_type == UNIGRAM and model.unk_id == 0
    assert (model.byte_fallback, model.dummy_prefix, model.collapse_spaces) == (
        options.get("byte_fallback", True), options.get("dummy_prefix", True), options.get("collapse", False))
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    codec = Codec(raw)
    data = [t.encode() for t in TEXTS]
    offsets = np.cumsum([0] + [len(x) for x in data])
    ids, at, same, whole = codec.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    got = [ids[at[i]:at[i + 1]].tolist() for i in range(len(TEXTS))]
    want = [reference.encode(t) for t in TEXTS]
    assert [g == w for g, w in zip(got, want, strict=True)] == same.tolist()
    assert got == want
    if not options:
        assert whole.all()


def test_unigram_through_spark(spark):
    raw = unigram_model()
    rows = encode_texts(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), raw)
    assert all(r.parity and r.round_trip for r in rows.collect())
    back = {r.doc_id: r.text for r in decode_ids(rows.select("doc_id", "ids"), raw).collect()}
    assert back == dict(enumerate(TEXTS))
    odd = encode_texts(odd_docs(spark), raw).collect()
    assert len(odd) == odd_docs(spark).count() and all(r.parity for r in odd)
    assert any(r.n_byte_tokens for r in odd)
