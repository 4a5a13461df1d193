"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the stored tables (or data Spark derives from them) in
full; computed columns carry the same names as in ``papyra.plans.oracle``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators import clean
from papyra.plans import views
from papyra.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Register a query; the package is shipped to the workers before it runs."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return deco


# ---- cleaning and assembly (C1-C12) -------------------------------------------------

@register("training_samples")
def q_training_samples(spark, sf_dir):
    return clean.training_samples(views.articles(spark, sf_dir))


@register("clean_articles")
def q_clean_articles(spark, sf_dir):
    a = clean.clean_articles(views.articles(spark, sf_dir))
    return a.select("idx", "article_id", "teaser_clean", "text_clean",
                    F.size("text").cast("bigint").alias("n_paragraphs"))


@register("omission_report")
def q_omission_report(spark, sf_dir):
    return clean.omission_report(views.articles(spark, sf_dir))


@register("clean_paragraphs")
def q_clean_paragraphs(spark, sf_dir):
    return clean.paragraph_report(views.articles(spark, sf_dir))


@register("clean_collapse_ws")
def q_clean_collapse_ws(spark, sf_dir):
    return clean.training_samples(views.articles(spark, sf_dir), ws_mode="collapse")


# ---- sources -----------------------------------------------------------------------

@register("raw_text_kinds")
def q_raw_text_kinds(spark, sf_dir):
    """Raw JSONL (derived from documents) written, scanned back with a VARIANT body."""
    from papyra.session import scratch_path
    from papyra.sources.readers import read_raw_articles, text_kind, well_formed
    path = scratch_path(spark, "raw-articles")
    views.raw_article_json(spark, sf_dir).write.mode("overwrite").text(path)
    raw = well_formed(read_raw_articles(spark, path))
    return raw.groupBy(text_kind(F.col("text")).alias("text_kind")).agg(F.count(F.lit(1)).alias("n"))


@register("raw_samples")
def q_raw_samples(spark, sf_dir):
    """S1 -> C1-C11: training samples from the scanned raw JSONL (string bodies as lines)."""
    from papyra.session import scratch_path
    from papyra.sources.readers import normalise_text, read_raw_articles, well_formed
    path = scratch_path(spark, "raw-articles")
    views.raw_article_json(spark, sf_dir).write.mode("overwrite").text(path)
    raw = normalise_text(well_formed(read_raw_articles(spark, path)), body_mode="lines")
    return clean.training_samples(raw)


def _written(spark, name, write) -> str:
    """A fresh folder of the shared scratch space that ``write`` has filled."""
    from papyra.session import scratch_path
    path = scratch_path(spark, name)
    write(path)
    return path


def _text_folders(df, key: str, order: list[str], files: int | None = None):
    """``df`` (key, order..., value) as text files in order below one folder per key; a key may span many files."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    return lambda path: dealt.select(key, "value").write.partitionBy(key).text(path)


@register("stored_samples")
def q_stored_samples(spark, sf_dir):
    """Processed samples written as JSONL and scanned back."""
    from papyra.sources.readers import read_samples
    return read_samples(spark, _written(spark, "samples-json", _samples(spark, sf_dir).write.json))


@register("qna_scan")
def q_qna_scan(spark, sf_dir):
    """S3: Q&A pairs written as JSONL under the second spelling of the name and scanned back."""
    from papyra.sources.readers import read_qna
    pairs = views.qna(spark, sf_dir)
    return read_qna(spark, _written(spark, "qna", lambda path: pairs.write.json(f"{path}/QnA.jsonl")))


@register("prompt_lines")
def q_prompt_lines(spark, sf_dir):
    """Prompt files of many lines, scanned with their line positions; blank lines count."""
    from papyra.sources.readers import numbered_lines
    from papyra.functions.text import py_strip
    from papyra.sources.readers import read_table
    lines = read_table(spark, sf_dir, "benchmark", "item_id", "text").select(
        "item_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    lines = lines.withColumn("part", (F.col("item_id") % 16).cast("int"))
    path = _written(spark, "prompts", _text_folders(lines, "part", ["item_id", "line"]))
    found = numbered_lines(spark, path, by_folder=True)
    return found.select(F.regexp_extract("file", "part=(.*)$", 1).cast("bigint").alias("part"),
                        F.col("line_no").alias("prompt_pos"), py_strip(F.col("value")).alias("prompt"))


@register("char_body_samples")
def q_char_body_samples(spark, sf_dir):
    """Training samples of the scanned raw JSONL with string bodies taken character by character."""
    from papyra.sources.readers import normalise_text, read_raw_articles, well_formed
    path = _written(spark, "raw-articles", views.raw_article_json(spark, sf_dir).write.text)
    return clean.training_samples(normalise_text(well_formed(read_raw_articles(spark, path)), body_mode="chars"))


@register("workflow_split")
def q_workflow_split(spark, sf_dir):
    """Prepare and split as committed steps (an unknown step is skipped); a second run reads what the first left."""
    from papyra.plans.workflow import run_steps
    from papyra.session import scratch_path
    params = {"sf_dir": sf_dir, "run_dir": scratch_path(spark, "workflow")}
    run_steps(spark, ["prepare"], params)
    split = run_steps(spark, ["prepare", "unknown", "split"], params)["split"]
    return split.select("idx", "article_id", "split", "rank", "split_rank")


# ---- page extraction (E1-E9) -------------------------------------------------------

def _pages(spark, sf_dir):
    from papyra.sources.readers import read_table
    return read_table(spark, sf_dir, "pages", "page_id", "url", "html")


@register("page_articles")
def q_page_articles(spark, sf_dir):
    from papyra.operators.extract import page_articles
    a = page_articles(views.press_pages(spark, sf_dir))
    return a.select("page_id", "url", "title", "date_raw", "category", "teaser", "text_kind",
                    F.size("paragraphs").cast("bigint").alias("n_paragraphs"),
                    F.array_join("paragraphs", "\n").alias("body"), "body_text")


@register("page_paragraphs")
def q_page_paragraphs(spark, sf_dir):
    from papyra.operators.extract import page_articles, page_paragraphs
    return page_paragraphs(page_articles(views.press_pages(spark, sf_dir)))


@register("page_links")
def q_page_links(spark, sf_dir):
    from papyra.operators.extract import listing_links
    return listing_links(_pages(spark, sf_dir))


@register("newsfeed_links")
def q_newsfeed_links(spark, sf_dir):
    """E1-E4 on the press listing layout, nested entries included."""
    from papyra.functions.html import NEWSFEED_LISTING
    from papyra.operators.extract import listing_links
    return listing_links(views.newsfeed_pages(spark, sf_dir), NEWSFEED_LISTING)


@register("newsroom_articles")
def q_newsroom_articles(spark, sf_dir):
    """E5-E9 on the press article layout."""
    from papyra.functions.html import NEWSROOM_PROFILE
    from papyra.operators.extract import page_articles
    a = page_articles(views.newsroom_pages(spark, sf_dir), NEWSROOM_PROFILE)
    return a.select("page_id", "title", "date_raw", "category", "teaser", "text_kind", F.array_join("paragraphs", "|").alias("body"))


@register("date_normalise")
def q_date_normalise(spark, sf_dir):
    from papyra.functions.dates import malformed_date, normalise_date
    d = views.dates(spark, sf_dir)
    return d.select("event_id", "date_text", normalise_date(F.col("date_text")).alias("date_raw"),
                    malformed_date(F.col("date_text")).alias("date_malformed"))


# ---- dataset building (D1-D8) -------------------------------------------------------

def _samples(spark, sf_dir):
    return clean.training_samples(views.articles(spark, sf_dir))


def _stored_samples(spark, sf_dir):
    from papyra.session import materialize
    return materialize(_samples(spark, sf_dir), "samples")


def _split(spark, sf_dir):
    """Samples with their split: the texts are stored once and stay where they are; ids alone are ranked."""
    from papyra.operators.dataset import split_boundary, with_split
    samples = _stored_samples(spark, sf_dir)
    return with_split(samples, split_boundary(samples, seed=42, test_size=0.1), seed=42)


def _split_ids(spark, sf_dir):
    from papyra.operators.dataset import split_ids
    return split_ids(_samples(spark, sf_dir).select("idx", "article_id"), seed=42, test_size=0.1)


def _vocab(spark, sf_dir):
    from papyra.operators.dataset import vocabulary
    from papyra.sources.readers import read_table
    return vocabulary(read_table(spark, sf_dir, "documents", "text"))


@register("incremental_new_docs")
def q_incremental_new_docs(spark, sf_dir):
    """Landed articles not stored yet (stored = articles already labelled)."""
    from papyra.operators.dataset import new_records, newest_marker
    from papyra.sources.readers import read_table
    batch = views.articles(spark, sf_dir).select("idx", "article_id", "title")
    stored = read_table(spark, sf_dir, "labels", "doc_id").select(
        F.col("doc_id").cast("string").alias("article_id"))
    marker = newest_marker(stored)
    new = new_records(batch, stored)
    return new.withColumn("newer_than_marker",
                          F.coalesce((F.col("article_id").try_cast("bigint") > F.lit(marker)).cast("int"),
                                     F.lit(0)))


@register("indexed_new_docs")
def q_indexed_new_docs(spark, sf_dir):
    """D1 by the id index: the stored ids (articles already labelled) are entered once, the batch asks its own buckets."""
    from papyra.operators.idindex import IdIndex
    from papyra.session import scratch_path
    from papyra.sources.readers import read_table
    index = IdIndex(spark, scratch_path(spark, "ids"), bucket_ids=4096)
    index.add(read_table(spark, sf_dir, "labels", "doc_id").select(F.col("doc_id").cast("string").alias("article_id")), "labels")
    batch = views.articles(spark, sf_dir).select("idx", "article_id", "title")
    return batch.join(index.missing(batch), "article_id", "left_semi").select("idx", "article_id", "title")


@register("committed_samples")
def q_committed_samples(spark, sf_dir):
    """Two committed writes, the first one repeated and overlapped by the second; each sample is stored once."""
    from papyra.session import scratch_path
    from papyra.sources.commits import read_committed
    from papyra.sources.sinks import store_new
    samples = _stored_samples(spark, sf_dir)
    path = scratch_path(spark, "committed")
    first = samples.where(F.col("idx") % 2 == 0)
    for rows, tag in ((first, "first"), (first, "first"), (samples, "second")):
        store_new(rows, path, tag)
    return read_committed(spark, path, samples.schema).select("idx", "article_id", "x", "tag")


@register("train_eval_split")
def q_train_eval_split(spark, sf_dir):
    return _split_ids(spark, sf_dir).select("idx", F.col("idx").cast("string").alias("article_id"),
                                            "split", "rank", "split_rank")


@register("split_sizes")
def q_split_sizes(spark, sf_dir):
    from papyra.operators.dataset import split_sizes
    return split_sizes(_samples(spark, sf_dir))


@register("vocab_topk")
def q_vocab_topk(spark, sf_dir):
    return _vocab(spark, sf_dir)


def _tokenized(spark, sf_dir):
    from papyra.operators.dataset import split_ids, tokenize
    samples = _stored_samples(spark, sf_dir)
    ids = split_ids(samples, seed=42, test_size=0.1).select("idx", "split", "split_rank")
    return tokenize(samples.select("idx", "x"), _vocab(spark, sf_dir)).join(ids, "idx")


@register("tokenized_samples")
def q_tokenized_samples(spark, sf_dir):
    from papyra.operators.dataset import UNK_ID
    t = _tokenized(spark, sf_dir)
    ids = F.col("input_ids")
    return t.select(
        "idx", "split", F.size(ids).cast("bigint").alias("n_tokens"),
        F.size(F.filter(ids, lambda i: i == UNK_ID)).cast("bigint").alias("n_unk"),
        F.aggregate(F.transform(ids, lambda i, k: i.cast("bigint") * (k + 1)), F.lit(0).cast("bigint"),
                    lambda a, v: a + v).alias("id_checksum"),
        F.element_at(ids, 1).cast("bigint").alias("first_id"))


@register("truncation_stats")
def q_truncation_stats(spark, sf_dir):
    from papyra.operators.dataset import truncation_stats
    return truncation_stats(_tokenized(spark, sf_dir), 512)


@register("collated_batches")
def q_collated_batches(spark, sf_dir):
    from papyra.operators.dataset import LABEL_PAD, collate
    c = collate(_tokenized(spark, sf_dir), batch_size=8)
    return c.select(
        "idx", "split", "batch_id", F.col("seq_len").cast("bigint").alias("seq_len"),
        F.col("batch_len").cast("bigint").alias("batch_len"),
        F.size(F.filter("labels", lambda v: v == LABEL_PAD)).cast("bigint").alias("n_pad"),
        F.size(F.filter("labels", lambda v: v != LABEL_PAD)).cast("bigint").alias("n_label_tokens"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("mask_sum"))


@register("step_assignment")
def q_step_assignment(spark, sf_dir):
    from papyra.operators.dataset import step_assignment
    train = _split_ids(spark, sf_dir).where(F.col("split") == "train").select("idx")
    return step_assignment(train, epochs=10, accum=8, seed=42)


# ---- evaluation grid, LMs, scores, summaries (J1-J3, V1-V10, A1-A7) --------------------

def _r6(df, *cols):
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _lms(spark, sf_dir, split=None):
    from papyra.operators import lm
    from papyra.sources.readers import read_table
    split = split if split is not None else _split(spark, sf_dir)
    train = split.where(F.col("split") == "train").select("x")
    return lm.fit(read_table(spark, sf_dir, "documents", "text"), train)


def _grid(spark, sf_dir):
    from papyra.operators.evaluation import qna_grid
    return qna_grid(views.qna(spark, sf_dir), views.predictions(spark, sf_dir))


def _nll(spark, sf_dir):
    from papyra.operators import lm
    return lm.qna_nll(_lms(spark, sf_dir), views.qna(spark, sf_dir))


def _bert(spark, sf_dir):
    from papyra.session import materialize
    return _scores(spark, sf_dir, materialize(_grid(spark, sf_dir), "grid"))


def _scores(spark, sf_dir, grid):
    from papyra.operators.evaluation import bertscore
    from papyra.sources.readers import read_table
    pairs = grid.select("model", "id", "prediction", "reference")
    texts = pairs.select(F.explode(F.array("prediction", "reference")).alias("text"))
    return bertscore(pairs, views.token_vectors(texts, read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def evaluate(spark, sf_dir, split=None):
    """The evaluation step: result rows (grid + BERTScore + masked NLL) and the per-model summary.

    ``split`` is the dataset split the n-gram variants are fitted on (built
    from the stored tables when not given).
    """
    from papyra.operators import lm
    from papyra.operators.evaluation import eval_results, summarise
    from papyra.session import materialize
    grid = materialize(_grid(spark, sf_dir), "grid")
    scores = _scores(spark, sf_dir, grid)
    # the grid holds every question once per model: its first model's rows are the Q&A pairs
    pairs = grid.where("model_pos = 0").select("id", "question", F.col("reference").alias("answer"))
    nll = lm.qna_nll(_lms(spark, sf_dir, split), pairs)
    results = eval_results(grid, scores, nll)
    return results, summarise(results)


def _summary(spark, sf_dir):
    return evaluate(spark, sf_dir)[1]


@register("prompt_grid")
def q_prompt_grid(spark, sf_dir):
    from papyra.operators.evaluation import prompt_grid
    return prompt_grid(views.prompts(spark, sf_dir))


@register("qna_grid")
def q_qna_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@register("missing_predictions")
def q_missing_predictions(spark, sf_dir):
    from papyra.operators.evaluation import missing_predictions
    return missing_predictions(views.qna(spark, sf_dir), views.predictions(spark, sf_dir))


@register("extract_answer")
def q_extract_answer(spark, sf_dir):
    from papyra.functions.text import extract_answer
    p = views.predictions(spark, sf_dir)
    return p.select("model", "id", extract_answer(F.col("full_text")).alias("prediction"))


@register("masked_nll")
def q_masked_nll(spark, sf_dir):
    return _r6(_nll(spark, sf_dir), "nll", "nll_full")


@register("perplexity_by_lang")
def q_perplexity_by_lang(spark, sf_dir):
    from papyra.operators import lm
    from papyra.sources.readers import read_table
    r = lm.nll_by_group(read_table(spark, sf_dir, "documents", "lang", "text"), "lang")
    return _r6(r.withColumn("perplexity", lm.perplexity(F.col("nll"))), "nll", "perplexity")


@register("bertscore_pairs")
def q_bertscore_pairs(spark, sf_dir):
    return _r6(_bert(spark, sf_dir), "bert_p", "bert_r", "bert_f1")


@register("bertscore_corpus")
def q_bertscore_corpus(spark, sf_dir):
    from papyra.operators.evaluation import bertscore_corpus
    return _r6(bertscore_corpus(_bert(spark, sf_dir)), "bert_p", "bert_r", "bert_f1")


@register("ngram_lm_nll")
def q_ngram_lm_nll(spark, sf_dir):
    """V8: NLL of every benchmark item under each fitted n-gram variant."""
    from papyra.operators import lm
    from papyra.sources.readers import read_table
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return _r6(lm.text_nll(_lms(spark, sf_dir), b, ["item_id"], "text"), "nll")


@register("lm_variant_nll")
def q_lm_variant_nll(spark, sf_dir):
    """Held-out mean NLL and perplexity of each variant on the eval split."""
    from papyra.operators import lm
    split = _split(spark, sf_dir)
    ev = split.where(F.col("split") == "eval").select("idx", "x")
    r = lm.corpus_nll(_lms(spark, sf_dir, split), ev, "x")
    return _r6(r.withColumn("perplexity", lm.perplexity(F.col("nll"))), "nll", "perplexity")


@register("eval_summary")
def q_eval_summary(spark, sf_dir):
    return _r6(_summary(spark, sf_dir), "nll", "bert_p", "bert_r", "bert_f1")


@register("eval_summary_sorted")
def q_eval_summary_sorted(spark, sf_dir):
    """A4 needs no NLL: no language model is fitted."""
    from papyra.operators.evaluation import SCORE_COLS, summarise, summary_sorted
    from papyra.session import materialize
    grid = materialize(_grid(spark, sf_dir), "grid")
    scored = grid.join(_scores(spark, sf_dir, grid), ["model", "id"], "left")
    return summary_sorted(summarise(scored, SCORE_COLS))


@register("best_marks")
def q_best_marks(spark, sf_dir):
    from papyra.operators.evaluation import best_marks
    return _r6(best_marks(_summary(spark, sf_dir)), "nll", "bert_p", "bert_r", "bert_f1")


@register("summary_cells")
def q_summary_cells(spark, sf_dir):
    from papyra.operators.evaluation import best_marks, summary_cells
    return summary_cells(best_marks(_summary(spark, sf_dir)))


@register("generations_by_prompt")
def q_generations_by_prompt(spark, sf_dir):
    from papyra.operators.evaluation import generations_by_prompt, with_models
    grid = with_models(views.prompts(spark, sf_dir))
    return generations_by_prompt(grid, views.generations(spark, sf_dir))


# ---- run telemetry (T1-T5, S8, S9) ---------------------------------------------------

@register("loss_curves")
def q_loss_curves(spark, sf_dir):
    from papyra.operators.telemetry import loss_curves
    return loss_curves(views.run_history(spark, sf_dir))


@register("overfit_flags")
def q_overfit_flags(spark, sf_dir):
    from papyra.operators.telemetry import overfit_flags
    return overfit_flags(views.run_history(spark, sf_dir))


@register("checkpoint_rank")
def q_checkpoint_rank(spark, sf_dir):
    from papyra.operators.telemetry import checkpoint_rank
    return checkpoint_rank(views.run_history(spark, sf_dir))


@register("variant_compare")
def q_variant_compare(spark, sf_dir):
    from papyra.operators.telemetry import variant_compare
    return variant_compare(views.run_history(spark, sf_dir))


@register("runlog_events")
def q_runlog_events(spark, sf_dir):
    from papyra.operators.telemetry import attach_continuations, parse_log
    return attach_continuations(parse_log(views.log_lines(spark, sf_dir)))


@register("step_durations")
def q_step_durations(spark, sf_dir):
    from papyra.operators.telemetry import parse_log, step_durations
    return step_durations(parse_log(views.log_lines(spark, sf_dir)))


@register("log_file_events")
def q_log_file_events(spark, sf_dir):
    """Logs written as folders of text files (a run each), scanned with line numbers through all files of a run."""
    from papyra.operators.telemetry import attach_continuations, parse_log
    from papyra.sources.readers import read_log_lines
    path = _written(spark, "logs", _text_folders(views.log_lines(spark, sf_dir), "run", ["line_no"]))
    lines = read_log_lines(spark, path, by_folder=True)
    lines = lines.withColumn("run", F.regexp_extract("run", "run=([^/]*)$", 1))
    return attach_continuations(parse_log(lines))


@register("log_steps")
def q_log_steps(spark, sf_dir):
    """T5: steps between the messages that report an elapsed time, with measured and reported seconds and counts."""
    from papyra.operators.telemetry import parse_log, step_intervals
    return step_intervals(parse_log(views.step_messages(spark, sf_dir)))


@register("log_step_report")
def q_log_step_report(spark, sf_dir):
    from papyra.operators.telemetry import parse_log, step_intervals, step_report
    return step_report(step_intervals(parse_log(views.step_messages(spark, sf_dir))))


def _history_metrics(spark, sf_dir):
    from papyra.sources.readers import read_history_metrics
    files = views.training_histories(spark, sf_dir)
    path = _written(spark, "histories", files.write.partitionBy("model", "checkpoint").text)
    return read_history_metrics(spark, path, name="part-*")


@register("history_metrics")
def q_history_metrics(spark, sf_dir):
    """Every metric of the written history files, declared or not."""
    from papyra.operators.telemetry import metric_summary
    return metric_summary(_history_metrics(spark, sf_dir))


@register("history_evaluations")
def q_history_evaluations(spark, sf_dir):
    """T1-T3 on written history files of mixed cadence."""
    from papyra.operators.telemetry import evaluation_report, records_of
    return evaluation_report(records_of(_history_metrics(spark, sf_dir)))


@register("history_summary")
def q_history_summary(spark, sf_dir):
    """T4 on written history files, with the figures of the closing record."""
    from papyra.operators.telemetry import closing_figures, records_of, variant_compare
    from papyra.session import materialize
    m = materialize(_history_metrics(spark, sf_dir), "history-metrics")
    return variant_compare(records_of(m)).join(closing_figures(m), "model")


# ---- streaming ingest (R1), batch map (U1) ---------------------------------------------

@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Raw files landed twice (a rerun) are ingested once each by a streaming job."""
    from papyra.session import scratch_path
    from papyra.streaming.ingest import ingest, ingested
    root = scratch_path(spark, "stream")
    raw = views.raw_article_json(spark, sf_dir)
    raw.write.mode("append").text(f"{root}/landing")
    raw.write.mode("append").text(f"{root}/landing")
    ingest(spark, f"{root}/landing", f"{root}/sink", f"{root}/checkpoint", max_files_per_trigger=4)
    return ingested(spark, f"{root}/sink")


@register("map_batches")
def q_map_batches(spark, sf_dir):
    from papyra.operators.batches import map_batches, text_stats
    return map_batches(_samples(spark, sf_dir), text_stats, "idx bigint, n_chars bigint, n_lines bigint",
                       remove_columns=["article_id", "x"])
