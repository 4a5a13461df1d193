"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text, normalised by length, with exception phrases.

``fold`` lower-cases, maps homoglyphs and (inside words that hold letters) digit and sign substitutions to plain
letters and replaces everything else by single spaces, so ``M0rоn`` and ``moron`` meet. ``learn_lexicon`` weighs
words and word stems by the log-odds of their document counts under the labels; ``ToxicityModel`` scans a folded text
once with one automaton for terms and exception phrases, drops term hits that lie inside an exception phrase, and
turns the weight sum and its density into a score by logistic regression. Null and empty texts have no hits.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stage

# fixed values: letters of other scripts that look like Latin ones, and digits or signs written for letters
HOMOGLYPHS = dict(zip("авеёзіїјкмнорстухѕԁɡɩαβεικνορτυχωı", "abeeziijkmhopctyxsdgiabeiknoptuxwi", strict=True))
SUBSTITUTES = dict(zip("0134578@$!|", "oieastbasil", strict=True))
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "recycled trash", "clown fish", "class clown",
              "pathetic fallacy", "idiot light", "idiot proof", "sore loser award")
_LOOKS = str.maketrans(HOMOGLYPHS)
_MARKED = re.compile(r"[^\W_]*[0-9@$!|][0-9@$!|\w]*")
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_OTHER = re.compile(r"[\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
STEMS = (4, 5, 6, 7, 8)


def _unmark(m: re.Match) -> str:
    word = m.group().rstrip("!|")
    tail = m.group()[len(word):]
    return (word.translate(_SUBSTITUTE) if _LETTER.search(word) else word) + tail


def fold(text: str | None) -> str:
    """Folded words, each between single spaces."""
    if not text:
        return " "
    plain = _MARKED.sub(_unmark, text.lower().translate(_LOOKS))
    return " " + _OTHER.sub(" ", plain).strip() + " "


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]  # " word " or " stem" -> weight
    exceptions: tuple[str, ...] = EXCEPTIONS
    coef: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.3, 0.3, 0.3]))

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            a.add_word(term, (weight, len(term), term))
        for phrase in self.exceptions:
            folded = fold(phrase)
            a.add_word(folded, (None, len(folded), folded))
        if len(a):
            a.make_automaton()
        return a

    def features(self, text: str | None, automaton: ahocorasick.Automaton) -> list[float]:
        """[1, weight sum, weight per 100 words, distinct terms]; one word adds its heaviest term only."""
        folded = fold(text)
        n_words = max(1, folded.count(" ") - 1)
        best: dict[int, tuple[float, str]] = {}
        allowed: list[tuple[int, int]] = []
        if len(automaton):
            for end, (weight, size, term) in automaton.iter(folded):
                start = end - size + 1
                if weight is None:
                    allowed.append((start, end))
                elif start not in best or best[start][0] < weight:
                    best[start] = (weight, term)
        hits = [h for at, h in best.items() if not any(a <= at < b for a, b in allowed)]
        total = sum(w for w, _ in hits)
        return [1.0, min(total, 60.0), min(100 * total / n_words, 60.0), float(min(len({t for _, t in hits}), 10))]

    def scores(self, texts: list[str | None], automaton: ahocorasick.Automaton) -> np.ndarray:
        x = np.array([self.features(t, automaton) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))


def learn_lexicon(train: DataFrame, min_share: float = 0.02, min_docs: int = 3, min_odds: float = 2.5,
                  max_terms: int = 4000) -> dict[str, float]:
    """Weights of words and stems from (text, label) rows: log-odds of document counts.

    A term enters when at least ``min_docs`` and a ``min_share`` of the toxic texts hold it and its log-odds reach
    ``min_odds``; the ``max_terms`` strongest are kept (a limit of the model, not of the corpus).
    """
    def terms(batches):
        for batch in batches:
            counts: Counter = Counter()
            toxic: Counter = Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(fold(text).split())
                found = {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}
                counts.update(found)
                if label:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64()),
                 pa.array([toxic[t] for t in counts], pa.int64())], ["term", "n", "toxic"])

    size = train.agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    n1, n0 = size["toxic"], size["n"] - size["toxic"]
    if not n1 or not n0:
        return {}
    odds = (F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n0 + 1)))
    counted = (train.select("text", "label").mapInArrow(terms, "term string, n long, toxic long")
               .groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
               .where(F.col("toxic") >= max(min_docs, int(min_share * n1))).withColumn("odds", odds)
               .where(F.col("odds") >= min_odds))
    rows = counted.orderBy(F.desc("odds"), "term").limit(max_terms).collect()
    return {r["term"]: float(r["odds"]) for r in rows}


def fit_toxicity(train: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, ridge: float = 0.05) -> ToxicityModel:
    """Lexicon, then Newton steps of a ridge logistic regression; every step sums a 4 x 4 system over partitions."""
    model = ToxicityModel(learn_lexicon(train), exceptions)

    def rows(batches):
        a = model.automaton()
        for batch in batches:
            x = np.array([model.features(t, a) for t in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    points = stage(train.select("text", "label").mapInArrow(rows, "x array<double>, y int"), "toxicity-points")
    coef = np.zeros(4)
    for _ in range(8):
        z = sum((F.col("x")[i] * float(coef[i]) for i in range(1, 4)), F.lit(float(coef[0])))
        p = 1 / (1 + F.exp(-z))
        at = points.withColumn("p", p)
        sums = at.agg(*[F.sum(F.col("x")[i] * (F.col("y") - F.col("p"))).alias(f"g{i}") for i in range(4)],
                      *[F.sum(F.col("x")[i] * F.col("x")[j] * F.col("p") * (1 - F.col("p"))).alias(f"h{i}{j}")
                        for i in range(4) for j in range(i, 4)]).first()
        if sums["g0"] is None:
            return model
        g = np.array([sums[f"g{i}"] for i in range(4)]) - ridge * coef
        h = np.array([[sums[f"h{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)]) + ridge * np.eye(4)
        step = np.linalg.solve(h, g)
        coef = coef + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    model.coef = coef
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) for every row, whole texts."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        a = model.automaton()
        for batch in batches:
            score = model.scores(batch.column(1).to_pylist(), a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["key", "score", "predicted"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, score double, predicted int")
    return out.withColumnRenamed("key", key)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held: int = 0, of: int = 5, max_train_rows: int = 12_000
                    ) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text); learn from labelled rows whose crc32 remainder is not ``held``.

    The model is fitted on about ``max_train_rows`` labelled rows (chosen by a hash of the id, so the chosen ids can
    be broadcast: under 1 MB). Repeated label rows of an id count once (the largest label); null labels and ids teach
    nothing. A null id is never held out.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
             .where(crc_mod(F.col("doc_id"), of) != held))
    share = min(1.0, max_train_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    train = stage(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label"), "toxic-train")
    scored = score_toxicity(docs, fit_toxicity(train))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), of) == held, F.lit(False)).alias("held_out"),
                         "score", "predicted")
