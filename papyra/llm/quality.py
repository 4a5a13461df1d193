"""Quality classifier: random Fourier features of document statistics, ridge normal equations, isotonic calibration.

``document_stats`` reduces every whole text to a fixed vector of statistics; ``fit_quality`` standardises them, maps
them to cosine features that approximate a Gaussian kernel, sums the normal equations over partitions, solves the
ridge system (a fixed size, whatever the input) and calibrates out-of-fold scores by isotonic regression;
``score_quality`` applies the model. Null and empty texts have the statistics of an empty text and get a score like
any other. Only the statistics are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, segment_ids, span_hashes, stage, text_slices, word_bounds

STATS = ["log_bytes", "log_words", "log_lines", "word_len", "upper", "digit", "symbol", "bang", "bar", "space",
         "wide", "stop", "distinct", "same_next", "tagged", "line_upper", "line_symbol", "line_bar", "line_same",
         "line_repeat", "capital"]
MIN_LINE = 20  # bytes; shorter lines do not enter the per-line maxima


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text of a slice."""
    n = len(offsets) - 1
    starts, ends = word_bounds(data, offsets)
    h = span_hashes(data, starts, ends)
    word_off = np.searchsorted(starts, offsets)
    doc = segment_ids(offsets, starts) if len(starts) else np.zeros(0, np.int64)
    words = np.diff(word_off).astype(float)
    size = np.diff(offsets).astype(float)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 0xC0)
    digit = (data >= 48) & (data <= 57)
    wide = data >= 128
    space = np.isin(data, [32, 9, 10, 11, 12, 13])
    stop = data == 46
    symbol = ~(letter | digit | wide | space | stop | (data == 44))
    bar, bang = data == 124, data == 33
    lines = _sums(data == 10, offsets) + (size > 0)
    letters = _sums(letter, offsets)
    # a word that repeats the one before it, a word that ends in a symbol other than a full stop or comma
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    tagged = symbol[ends - 1] if len(ends) else np.zeros(0, bool)
    capital = upper[starts] if len(starts) else np.zeros(0, bool)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n).astype(float) if len(h) else np.zeros(n)
    # per line
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    line_doc = segment_ids(offsets, cuts[:-1]) if len(cuts) > 1 else np.zeros(0, np.int64)
    line_size = np.diff(cuts).astype(float)
    line_words = np.diff(np.searchsorted(starts, cuts)).astype(float)
    long_line = line_size >= MIN_LINE

    def worst(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, line_doc[long_line], values[long_line])
        return out

    same_total = np.zeros(len(same) + 1, np.int64)
    np.cumsum(same, out=same_total[1:])
    at = np.searchsorted(starts, cuts)
    line_same = (same_total[at[1:]] - same_total[at[:-1]]).astype(float) if len(cuts) > 1 else np.zeros(0)
    filled = line_size > 1
    lh = span_hashes(data, cuts[:-1][filled], cuts[1:][filled])
    ld = line_doc[filled]
    lo = np.lexsort((lh, ld))
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[lo][1:] == lh[lo][:-1]) & (ld[lo][1:] == ld[lo][:-1])
    repeat = np.bincount(ld[lo][again], minlength=n).astype(float) if len(lh) else np.zeros(n)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), np.minimum(_ratio(size, words), 50),
        _ratio(_sums(upper, offsets), letters), _ratio(_sums(digit, offsets), size),
        _ratio(_sums(symbol, offsets), size), _ratio(_sums(bang, offsets), words), _ratio(_sums(bar, offsets), words),
        _ratio(_sums(space, offsets), size), _ratio(_sums(wide, offsets), size), _ratio(_sums(stop, offsets), words),
        _ratio(distinct, words), _ratio(_sums(same, word_off), words), _ratio(_sums(tagged, word_off), words),
        worst(_ratio(_sums(upper, cuts), np.maximum(_sums(letter, cuts), 10))),
        worst(_ratio(_sums(symbol, cuts), line_size)), worst(_ratio(_sums(bar, cuts), line_words)),
        worst(_ratio(line_same, line_words)), _ratio(repeat, lines), _ratio(_sums(capital, word_off), words)])


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, stats array<double>) for every row; null text counts as empty."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["key"]

    def run(batches):
        for rows, data, offsets in text_slices(batches):
            values = _stats(data, offsets)
            flat = pa.array(values.ravel())
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATS)), flat)
            yield pa.RecordBatch.from_arrays([rows.column(0), stats], ["key", "stats"])
        give_back()

    return rows.mapInArrow(run, f"key {kind}, stats array<double>").withColumnRenamed("key", key)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # random projection, one column per feature
    phase: np.ndarray
    beta: np.ndarray
    knots_x: np.ndarray
    knots_y: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([f, np.ones(len(f))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def calibrated(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots_x, self.knots_y), 0, 1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("stats")).flatten().to_numpy(zero_copy_only=False).reshape(
        -1, len(STATS))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x centre, fitted y) of the non-decreasing weighted least-squares fit."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return (np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks]))


def fit_quality(train: DataFrame, n_features: int = 320, ridge: float = 1e-3, gamma: float = 0.35, bins: int = 2000,
                seed: int = 7) -> QualityModel:
    """Fit on (stats, label, fold) rows with labels 0/1 and folds 0/1.

    Every partition adds its rows into the normal equations of their fold; the sums meet in a tree, so the driver
    receives one matrix of (n_features + 1)^2 numbers per fold. Out-of-fold scores are counted into ``bins`` equal
    bins before the isotonic fit. Without any rows the model returns 0.5 for everything; with one class only it
    returns that class.
    """
    d = len(STATS)
    rng = np.random.default_rng(seed)
    moments = train.select(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)],
                           *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)],
                           F.count("label").alias("n"), F.avg("label").alias("rate")).first()
    n = moments["n"]
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([moments[f"s{i}"] or 0.0 for i in range(d)])
    scale[scale < 1e-9] = 1.0
    model = QualityModel(mean, scale, rng.normal(0, gamma, (d, n_features)), rng.uniform(0, 2 * np.pi, n_features),
                         np.zeros(n_features + 1), np.array([0.0]), np.array([0.5]))
    if not n or moments["rate"] in (0.0, 1.0):
        if n:
            model.knots_y = np.array([float(moments["rate"])])
        return model
    m = n_features + 1

    def sums(batches):
        total = np.zeros((2, m, m + 1))
        for batch in batches:
            f, y, fold = model.features(_stats_of(batch)), _column(batch, "label"), _column(batch, "fold")
            for k in (0, 1):
                g = f[fold == k]
                total[k, :, :m] += g.T @ g
                total[k, :, m] += g.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = train.select("stats", "label", "fold").mapInArrow(sums, "sums binary")
    total = parts.rdd.map(lambda r: np.frombuffer(bytes(r[0])).reshape(2, m, m + 1)).treeReduce(np.add, depth=3)

    def solve(t: np.ndarray) -> np.ndarray:
        a = t[:, :m].copy()
        a[np.diag_indices(m)] += ridge * max(t[-1, m - 1], 1.0) / m + 1e-9
        return np.linalg.solve(a, t[:, m])

    model.beta = solve(total[0] + total[1])
    other = [solve(total[1]) if total[1].any() else model.beta, solve(total[0]) if total[0].any() else model.beta]

    def out_of_fold(batches):
        for batch in batches:
            f, fold = model.features(_stats_of(batch)), _column(batch, "fold")
            raw = np.where(fold == 0, f @ other[0], f @ other[1])
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(_column(batch, "label").astype(float))],
                                             ["raw", "label"])

    binned = (train.select("stats", "label", "fold").mapInArrow(out_of_fold, "raw double, label double")
              .groupBy(F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) + 0.5) * (bins / 2)).alias("bin"))
              .agg(F.count("label").alias("n"), F.sum("raw").alias("x"), F.sum("label").alias("y")))
    rows = sorted(binned.collect(), key=lambda r: r["bin"])  # at most bins + 1 rows
    w = np.array([r["n"] for r in rows], float)
    # one pseudo-row of each class per end keeps the extremes away from 0 and 1
    model.knots_x, model.knots_y = isotonic(np.array([r["x"] for r in rows]) / w, np.array([r["y"] for r in rows]) / w, w)
    return model


def score_quality(stats: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) for (key, stats) rows."""
    kind = dict(stats.dtypes)[key]

    def run(batches):
        for batch in batches:
            score = model.calibrated(_stats_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["key", "score", "predicted"])

    out = stats.select(F.col(key).alias("key"), "stats").mapInArrow(run, f"key {kind}, score double, predicted int")
    return out.withColumnRenamed("key", key)


MAX_TRAIN_ROWS = 200_000  # labelled rows that a model is fitted on at most (about; chosen by a hash of the id)


def training_labels(labels: DataFrame, held: int = 1, of: int = 3, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, label) of the ids that a model learns from: labels (doc_id, quality) of ids whose crc32 remainder is not
    ``held``, about ``max_train_rows`` at most, chosen by a hash of the id. Repeated label rows of an id count once (the
    smallest label); null labels and null ids teach nothing.
    """
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
             .where(crc_mod(F.col("doc_id"), of) != held))
    share = min(1.0, max_train_rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def learn_quality(stats: DataFrame, labels: DataFrame, held: int = 1, of: int = 3, max_train_rows: int = MAX_TRAIN_ROWS
                  ) -> QualityModel:
    """Model from (doc_id, stats) and the ``training_labels`` of labels (doc_id, quality)."""
    picked = training_labels(labels, held, of, max_train_rows)
    train = stage(stats.join(picked, "doc_id").select(
        "stats", "label", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")), "train")
    return fit_quality(train)


def quality_scores(docs: DataFrame, labels: DataFrame, held: int = 1, of: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text); a null id is never held out."""
    stats = stage(document_stats(docs), "doc-stats")
    scored = score_quality(stats, learn_quality(stats, labels, held, of))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), of) == held, F.lit(False)).alias("held_out"),
                         "score", "predicted")


def learn_from_texts(docs: DataFrame, labels: DataFrame, held: int = 1, of: int = 3) -> QualityModel:
    """Model from docs (doc_id, text) and labels; only the texts that are learned from are reduced to statistics."""
    picked = stage(training_labels(labels, held, of), "training-labels")  # MAX_TRAIN_ROWS ids: a bounded broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text")
    return learn_quality(stage(document_stats(texts), "training-stats"), labels, held, of)


TEXT_SLICE = 1 << 20  # bytes of text that are reduced at once when whole rows wait


def accepted(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model accepts (score of 0.5 and more); no row moves between partitions.

    Only the text goes to Python and only a flag comes back; the rows wait in the executor, which spills them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = iter([pa.RecordBatch.from_arrays([texts], ["text"])])
            parts = [shared.value.calibrated(_stats(data, offsets)) >= 0.5 for _, data, offsets in text_slices(rows, TEXT_SLICE)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())
        give_back()

    return docs.where(keep(F.col(text)))
