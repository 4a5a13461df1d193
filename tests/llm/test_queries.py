"""The registered queries' derived columns against brute force on the whole small tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np

from papyra.llm.queries import QUERIES

from .helpers import SF, documents, sha, shingles


def test_op6_columns(spark):
    rows = {r.doc_id: (r.text or "").encode() for r in documents(spark).collect()}
    size = 400
    held = Counter(hash(t[i:i + size]) for t in rows.values() for i in range(len(t) - size + 1))
    got = {r.doc_id: r for r in QUERIES["op6_suffix_dedup"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    removed = 0
    for i, t in rows.items():
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if held[hash(t[p:p + size])] > 1:
                gone[p:p + size] = b"\1" * size
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), spans, sha(kept))
        removed += sum(gone)
    assert removed > 0


def test_op4_columns(spark):
    rows = {r.doc_id: r.text for r in documents(spark).collect()}
    got = {r.doc_id: r for r in QUERIES["op4_jaccard_join"](spark, SF).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t)) for i, t in rows.items()}
    assert all(r.component_id <= i and got[r.component_id].component_id == r.component_id for i, r in got.items())


def test_op3_scores_by_plain_normal_equations(spark):
    """The summed equations give the weights that one matrix of all rows gives."""
    from papyra.llm.quality import document_stats, fit_quality, learn_quality, training_labels
    from pyspark.sql import functions as F
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stats = document_stats(documents(spark))
    model = learn_quality(stats, labels)
    train = stats.join(training_labels(labels), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in train)
    x = model.features(np.array([r.stats for r in train]))
    y = np.array([r.label for r in train], float)
    a = x.T @ x
    m = len(a)
    a[np.diag_indices(m)] += 1e-3 * len(y) / m + 1e-9
    beta = np.linalg.solve(a, x.T @ y)
    assert np.allclose(model.raw(np.array([r.stats for r in train])), x @ beta, atol=1e-6)
    one_class = fit_quality(stats.select("stats", F.lit(1).alias("label"), F.lit(0).alias("fold")))
    assert one_class.knots_y.tolist() == [1.0]


def test_op9_records_hold_what_they_say(spark):
    """Lengths, digests and links of every derived record, recomputed from its bytes."""
    import base64

    from papyra.llm.common import table
    from papyra.llm.warc import derive, responses_of_pages
    source = responses_of_pages(table(spark, SF, "pages"))
    made = derive(source).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert Counter(r.source_key for r in made) == {i: 2 for i in pages}
    for r in made:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert body == bytes(r.block) + b"\r\n\r\n" and int(fields["Content-Length"]) == len(r.block)
        assert fields["WARC-Type"] == r.kind and r.kind in ("metadata", "conversion")
        assert fields["WARC-Refers-To"] == r.identifier and fields["WARC-Target-URI"] == r.target == pages[r.source_key]
        digest = "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.block)).digest()).decode()
        assert fields["WARC-Block-Digest"] == r.block_digest == digest
    assert len({r.record_id for r in made}) == len(made)
