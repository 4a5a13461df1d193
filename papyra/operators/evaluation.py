"""Evaluation grid, answer extraction, BERTScore matching and summaries
(J1-J3, V1-V2, V6-V7, A1-A7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra import DEFAULT_MODELS
from papyra.functions.models import model_array
from papyra.functions.text import extract_answer, tokens

# The Q&A prompt template.
PROMPT_Q, PROMPT_A = "Q: ", "\nA:"


def with_models(df: DataFrame, models=DEFAULT_MODELS) -> DataFrame:
    """Every row once per model (a bounded, literal fan-out; no join)."""
    return (df.select("*", F.explode(model_array(models)).alias("_m"))
            .select("_m.model", "_m.model_pos", *df.columns))


def prompt_grid(prompts: DataFrame, models=DEFAULT_MODELS, order=("prompt_pos", "line_no")) -> DataFrame:
    """Prompts x models, ordered prompt-major then by model."""
    order = [c for c in order if c in prompts.columns]
    return with_models(prompts, models).orderBy(*order, "model_pos")


def qna_prompt(question) -> F.Column:
    """V1: ``Q: q\\nA:``"""
    return F.concat(F.lit(PROMPT_Q), question, F.lit(PROMPT_A))


def qna_full(question, answer) -> F.Column:
    """V1: ``Q: q\\nA: a`` (the NLL input)."""
    return F.concat(F.lit(PROMPT_Q), question, F.lit(PROMPT_A + " "), answer)


def qna_grid(qna: DataFrame, outputs: DataFrame, models=DEFAULT_MODELS) -> DataFrame:
    """J2 + J3: models x Q&A with the model's extracted answer attached.

    ``outputs`` holds (model, id, full_text); a grid row without output keeps
    a null prediction (list them with ``missing_predictions``).
    """
    grid = with_models(qna, models)
    preds = outputs.select("model", "id", extract_answer(F.col("full_text")).alias("prediction"))
    return (grid.join(preds, ["model", "id"], "left")
            .select("model", "model_pos", "id", "question", F.col("answer").alias("reference"),
                    qna_prompt(F.col("question")).alias("prompt"), "prediction"))


def missing_predictions(qna: DataFrame, outputs: DataFrame, models=DEFAULT_MODELS) -> DataFrame:
    """Grid cells with no model output."""
    return with_models(qna, models).join(outputs.select("model", "id"), ["model", "id"], "left_anti") \
        .select("model", "model_pos", "id")


# ---- V6/V7 BERTScore ---------------------------------------------------------------------

def _match_weighted(pm: np.ndarray, pc: np.ndarray, rm: np.ndarray, rc: np.ndarray, block: int = 4096):
    best_p = np.empty(len(pm))
    best_r = np.full(len(rm), -np.inf)
    for i in range(0, len(pm), block):       # bounded similarity block
        sim = pm[i:i + block] @ rm.T
        best_p[i:i + block] = sim.max(axis=1)
        best_r = np.maximum(best_r, sim.max(axis=0))
    bp = float((pc * best_p).sum() / pc.sum())
    br = float((rc * best_r).sum() / rc.sum())
    f1 = 2 * bp * br / (bp + br) if (bp + br) != 0 else 0.0
    return bp, br, f1


SCORE_COLS = ["bert_p", "bert_r", "bert_f1"]
PAIR_BLOCK = 1 << 20  # characters of text whose token vectors meet in one task


def bertscore(pairs: DataFrame, vectors: DataFrame, pred_col: str = "prediction",
              ref_col: str = "reference", keys=("model", "id"), n_blocks: int | None = None) -> DataFrame:
    """V6: greedy cosine matching of token embeddings (Zhang et al., 2020).

    P = mean over prediction tokens of the best cosine against the reference
    tokens, R the reverse, F1 their harmonic mean; whole texts are used and
    pairs with an empty side score 0. ``vectors`` holds (tok, embedding), one
    row per token; a token without a vector matches nothing (cosine 0).

    Pairs are dealt into blocks of about ``PAIR_BLOCK`` characters. A block
    gathers one copy of the vector of each distinct token it holds and scores
    its pairs there, one blocked matrix product per pair.
    """
    from papyra.operators.blocks import block_count, lookup_in_blocks
    keys = list(keys)
    rows = pairs.select(*keys, tokens(F.col(pred_col)).alias("_p"), tokens(F.col(ref_col)).alias("_r"))
    if n_blocks is None:
        text = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint")
        n_blocks = block_count(pairs, text(pred_col) + text(ref_col), PAIR_BLOCK)
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in SCORE_COLS])

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        unit = _unit_rows(known["embedding"])
        scores = np.zeros((block.num_rows, 3))
        (p, p_at), (r, r_at) = (_known_tokens(block[c], known["tok"]) for c in ("_p", "_r"))
        for i in range(block.num_rows):
            a, b = p[p_at[i]:p_at[i + 1]], r[r_at[i]:r_at[i + 1]]
            if len(a) and len(b) and (a.max() >= 0 or b.max() >= 0):
                (a, na), (b, nb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
                scores[i] = _match_weighted(unit[a], na, unit[b], nb)        # -1, no vector: the row of zeros at the end
        return pa.table([block[k] for k in keys] + [pa.array(c) for c in scores.T], names=[*keys, *SCORE_COLS])

    return lookup_in_blocks(rows, ["_p", "_r"], vectors.select("tok", "embedding"), score, schema, n_blocks, keys)


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length one (a null or zero vector stays zero), and a row of zeros at the end."""
    lists = [x for x in column.to_numpy()]
    width = max((len(x) for x in lists if x is not None), default=0)
    out = np.zeros((len(lists) + 1, width))
    for i, x in enumerate(lists):
        if x is not None and len(x) == width:
            out[i] = x
    size = np.sqrt((out ** 2).sum(axis=1))
    return out / np.where(size > 0, size, 1)[:, None]


def _known_tokens(column: pa.ChunkedArray, known: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each token in ``known`` or -1, bounds of the rows' tokens); a null list is empty."""
    from papyra.operators.blocks import positions_in
    lists, at = positions_in(column, known)
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=bounds[1:])
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False), bounds


def bertscore_corpus(scores: DataFrame, by: str = "model") -> DataFrame:
    """V7: mean P, R, F1 per model."""
    return scores.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("bert_p", "bert_r", "bert_f1")])


# ---- A1-A7 summaries ------------------------------------------------------------------------

# How far a figure may lie from the best one to be marked, and how a cell prints it.
TIE, CELL = 1e-12, "%.4f"
METRICS = ("nll", "bert_p", "bert_r", "bert_f1")
LARGER_IS_BETTER = {"nll": False, "bert_p": True, "bert_r": True, "bert_f1": True}


def eval_results(grid: DataFrame, scores: DataFrame, nll: DataFrame) -> DataFrame:
    """A1: one result row per (model, id): texts and all metrics."""
    return (grid.join(scores, ["model", "id"], "left").join(nll.select("model", "id", "nll"), ["model", "id"], "left")
            .select("model", "model_pos", "id", "question", "reference", "prediction", *METRICS))


def summarise(results: DataFrame, metrics=METRICS) -> DataFrame:
    """A2/A3: per-model means (NaN skipped), keyed by declared model order."""
    aggs = [F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(m) for m in metrics]
    # one row per observed model, in declared order (sorting k rows)
    return results.groupBy("model", "model_pos").agg(*aggs).orderBy("model_pos")


def summary_sorted(summary: DataFrame) -> DataFrame:
    """A4: means without nll, rounded to 4, ranked ascending by bert_p (k rows: one window)."""
    s = summary.select("model", *[F.round(c, 4).alias(c) for c in ("bert_p", "bert_r", "bert_f1")])
    return (s.withColumn("sort_rank", F.row_number().over(Window.orderBy("bert_p", "model")).cast("bigint"))
            .orderBy("sort_rank"))


def best_marks(summary: DataFrame, eps: float = TIE) -> DataFrame:
    """A5: flag the best value per metric (min for nll, max otherwise); ties all flagged."""
    w = Window.partitionBy()   # the summary has one row per model
    cols = []
    for m in METRICS:
        target = F.max(m).over(w) if LARGER_IS_BETTER[m] else F.min(m).over(w)
        cols.append((F.abs(F.col(m) - target) < eps).cast("int").alias(f"best_{m}"))
    return summary.select("model", "model_pos", *METRICS, *cols)


def summary_cells(marked: DataFrame) -> DataFrame:
    """Display cells ``%.4f``, bold (``**x**``) where best, per model in order."""
    cells = []
    for m in METRICS:
        txt = F.format_string(CELL, F.col(m))
        cells.append(F.when(F.col(f"best_{m}") == 1, F.concat(F.lit("**"), txt, F.lit("**")))
                     .otherwise(txt).alias(f"{m}_cell"))
    row = F.concat(F.lit("| "), F.col("model"), F.lit(" | "),
                   F.concat_ws(" | ", *[F.col(f"{m}_cell") for m in METRICS]), F.lit(" |"))
    return (marked.select("model", "model_pos", *cells)
            .withColumn("markdown_row", row).orderBy("model_pos"))


def generations_by_prompt(grid: DataFrame, outputs: DataFrame, keys=("prompt_pos", "line_no")) -> DataFrame:
    """Per prompt, every model's output in model order (bounded by the model count)."""
    keys = [k for k in keys if k in grid.columns]
    j = grid.join(outputs, [*keys, "model"], "left")
    g = j.groupBy(*keys, "prompt").agg(
        F.sort_array(F.collect_list(F.struct("model_pos", "model", "gen_text"))).alias("outs"))
    return g.select(*keys, "prompt", F.size("outs").cast("bigint").alias("n_models"),
                    F.array_join(F.transform("outs", lambda o: F.concat(F.lit("["), o["model"], F.lit("] "),
                                                                     F.coalesce(o["gen_text"], F.lit("")))),
                                 "\n").alias("outputs"))
