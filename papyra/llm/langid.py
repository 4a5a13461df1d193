"""Language identification: nearest centroid by cosine over normalised TF-IDF vectors of byte n-grams.

A text is read as UTF-8 with A-Z lower-cased; every ASCII byte that is no letter separates words. Its vector counts the
n-grams of one to four bytes (a separator at most once in a row) in ``DIM`` hashed cells, as log(1 + count) times the
inverse document frequency, scaled to length one. Each language is described by several centroids, found by spherical
k-means among those of its texts that lie nearest to its own middle (so that wrong labels form no centroid); a text takes the language of its nearest centroid. It is flagged ``rejected`` when it lies
farther from that centroid than the centroid's own members do (mean distance plus ``REJECT_SD`` deviations).

Document frequencies are summed over all training texts, one fixed-size vector per partition. The centroids are fitted
on at most about ``per_lang`` training texts of each language (a parameter; chosen by a hash of the id). The model is
of a fixed size per language. Null texts and texts without a letter are ``und`` with score 0; so is every text when
nothing could be learned. Rows without id are scored but teach nothing, rows without language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, lower_bytes, stage, text_slices

BITS = 14
DIM = 1 << BITS
ORDERS = 4
GROUP = 16  # texts counted together
PIECE = 1 << 20  # bytes counted at once; a longer text is counted piece by piece
REJECT_SD = 6.0
UNKNOWN = "und"
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)  # odd multipliers, one per order


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with two separators (0) around each text, so that no n-gram crosses a text's bound."""
    n = len(offsets) - 1
    starts = offsets[:-1] + 2 * np.arange(1, n + 1)
    out = np.zeros(len(data) + 2 * (n + 1), np.uint8)
    low = lower_bytes(data)
    low[~(((low >= 97) & (low <= 122)) | (low >= 128))] = 0
    out[np.arange(len(data)) + 2 * (np.repeat(np.arange(n), np.diff(offsets)) + 1)] = low
    return out, starts


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIM) counts of the n-grams of back-to-back texts."""
    n = len(offsets) - 1
    text, starts = _padded(data, offsets)
    # the two separators before a text count as its own; no n-gram starts at the second one after the last text
    cell0 = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(np.append(starts - 2, len(text) - 2)))
    total = np.zeros(n * DIM, np.int64)
    for lo in range(0, len(cell0), PIECE):
        size = min(PIECE, len(cell0) - lo)
        part = np.zeros(size + ORDERS - 1, np.uint32)
        got = text[lo:lo + size + ORDERS - 1]
        part[:len(got)] = got
        gap = part == 0
        code = np.zeros(size, np.uint32)
        use = ~gap[:size]
        valid = np.ones(size, bool)
        cells = []
        for k in range(ORDERS):
            code |= part[k:k + size] << np.uint32(8 * k)
            if k:
                valid &= ~(gap[k - 1:k - 1 + size] & gap[k:k + size])
                use = valid
            cells.append(((code * _MIX[k]) >> np.uint32(32 - BITS)).astype(np.int64)[use] + cell0[lo:lo + size][use])
        total += np.bincount(np.concatenate(cells), minlength=n * DIM)
    return total.reshape(n, DIM)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, counts) for groups of whole texts."""
    for rows, data, offsets in text_slices(batches):
        for lo in range(0, rows.num_rows, GROUP):
            part = offsets[lo:lo + GROUP + 1]
            yield rows.slice(lo, GROUP), gram_counts(data[part[0]:part[-1]], part - part[0])


@dataclass
class LanguageModel:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit vectors, a row per centroid
    limit: np.ndarray  # largest accepted distance of each centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        row, cell = at // DIM, at % DIM
        value = np.log1p(counts.ravel()[at]).astype(np.float32) * self.idf[cell]
        size = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, minlength=len(counts)))
        x = np.zeros(counts.size, np.float32)
        x[at] = value / size[row]
        return x.reshape(counts.shape)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Element-wise sum of the vectors of ``size`` numbers that ``run`` yields, one per partition at most."""
    parts = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    return parts.treeAggregate(np.zeros(size), np.add, np.add, depth=3)


def _row(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.astype(np.float64).tobytes()], pa.binary())], ["sums"])


def _document_frequencies(train: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(DIM + 1)
        for _, counts in _groups(batches):
            total[:DIM] += (counts > 0).sum(axis=0)
            total[DIM] += len(counts)
        yield _row(total)

    return _summed(train.select("text"), run, DIM + 1)


def _labels(rows: pa.RecordBatch) -> np.ndarray:
    return np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), dtype=object)


def fit_languages(train: DataFrame, per_lang: int = 4000, clusters: int = 4, rounds: int = 4) -> LanguageModel:
    """Model from (id, text, lang) rows without nulls in id and lang (a null text counts as empty)."""
    sums = _document_frequencies(train)
    idf = (np.log((1 + sums[DIM]) / (1 + sums[:DIM])) + 1).astype(np.float32)
    model = LanguageModel(idf, [], np.zeros((0, DIM), np.float32), np.zeros(0))
    sizes = train.groupBy("lang").agg(F.count("id").alias("n"))
    order = F.xxhash64("id")
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n"))
    sample = stage(train.where(F.col("text").rlike("\\p{L}")).join(F.broadcast(sizes), "lang")  # a row per language
                   .where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).select("id", "text", "lang"), "lang-sample")

    names = np.array(sorted(r["lang"] for r in sizes.collect()), dtype=object)  # a row per language
    if not len(names):
        return model

    def means(batches):
        """Sum of the vectors of each language."""
        total = np.zeros((len(names), DIM))
        for rows, counts in _groups(batches):
            label = _labels(rows)
            x = model.vectors(counts)
            for i, name in enumerate(names):
                total[i] += x[label == name].sum(axis=0)
        yield _row(total.ravel())

    middle = _unit(_summed(sample.select("text", "lang"), means, len(names) * DIM).reshape(-1, DIM))

    def typical(batches):
        """The texts that lie nearest to the middle of their own language; a wrong label teaches nothing."""
        for rows, counts in _groups(batches):
            best = (model.vectors(counts) @ middle.T).argmax(axis=1)
            yield rows.filter(pa.array(names[best] == _labels(rows)))

    kept = stage(sample.mapInArrow(typical, sample.schema), "lang-typical")

    def vectors(batches):
        for rows, counts in _groups(batches):
            found = pa.array([v.tobytes() for v in model.vectors(counts)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(1), found], ["lang", "v"])

    by_hash = Window.partitionBy("lang").orderBy(order, "text")
    seeds = (kept.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= clusters).select("text", "lang")
             .mapInArrow(vectors, "lang string, v binary").collect())
    start = sorted((r["lang"], bytes(r["v"])) for r in seeds)
    # a language without a typical text is described by its middle
    lost = [(name, middle[i].tobytes()) for i, name in enumerate(names) if name not in {a for a, _ in start}]
    model.languages = [a for a, _ in start + lost]
    model.centroids = np.array([np.frombuffer(v, np.float32) for _, v in start + lost])
    model.limit = np.ones(len(model.languages))

    def assign(batches):
        """Sums of the members' vectors of each centroid, and of their count, distance and squared distance."""
        total = np.zeros((len(model.languages), DIM + 3))
        own = np.array(model.languages, dtype=object)
        for rows, counts in _groups(batches):
            x = model.vectors(counts)
            cos = np.where(_labels(rows)[:, None] == own, x @ model.centroids.T, -2)
            best = cos.argmax(axis=1)
            far = 1 - cos[np.arange(len(best)), best]
            for c in np.unique(best):
                mine = best == c
                total[c, :DIM] += x[mine].sum(axis=0)
                total[c, DIM:] += mine.sum(), far[mine].sum(), (far[mine] ** 2).sum()
        yield _row(total.ravel())

    for turn in range(rounds + 1):
        total = _summed(kept.select("text", "lang"), assign, len(model.languages) * (DIM + 3)).reshape(-1, DIM + 3)
        live = np.flatnonzero(total[:, DIM] > 0)  # a centroid without members stays where it is
        n, mean = total[live, DIM], total[live, DIM + 1] / total[live, DIM]
        if turn < rounds:
            model.centroids = model.centroids.copy()
            model.centroids[live] = _unit(total[live, :DIM])
        else:
            model.limit[live] = mean + REJECT_SD * np.sqrt(np.maximum(total[live, DIM + 2] / n - mean ** 2, 0)) + 1e-6
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row; score is the cosine with the nearest centroid."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                       F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("readable"))
    kind = dict(rows.dtypes)["key"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size per language

    def run(batches):
        m = shared.value
        for part, counts in _groups(batches):
            readable = part.column(2).to_numpy(zero_copy_only=False)
            n = len(counts)
            names, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            if m.languages and readable.any():
                cos = m.vectors(counts) @ m.centroids.T
                best = cos.argmax(axis=1)
                near = cos[np.arange(n), best].astype(np.float64)
                names = np.where(readable, np.array(m.languages, dtype=object)[best], UNKNOWN)
                score = np.where(readable, near.clip(0, 1), 0.0)
                rejected = ~readable | (1 - near > m.limit[best])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                                             ["key", "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("key", key)


def language_ids(docs: DataFrame, held: int = 2, of: int = 4, per_lang: int = 4000, clusters: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs`` (doc_id, text, lang).

    Learns from rows with id and language whose crc32 remainder is not ``held``; a null id is never held out.
    """
    known = (docs.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), of) != held))
             .select(F.col("doc_id").alias("id"), "text", "lang"))
    found = predict_languages(docs, fit_languages(known, per_lang, clusters))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), of) == held, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "rejected")
