"""Run telemetry as tables (T1-T5, S8, S9): loss curves, overfit flags,
checkpoint ranking, variant comparison, log parsing and step durations.

Windows here run over per-(model, step) aggregates, whose size is bounded by
the number of steps; the per-event step durations use ``lead_in_order`` so a
component holding most log lines is still split across tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.ranking import fill_forward, lead_in_order

# The log line layout "[ts] [ LEVEL ] [ component ] indent+message".
LOG_LINE_RE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[\s*([A-Za-z]+)\s*\] \[\s*(.*?)\s*\] ( *)(.*)$"
LOG_TS = "yyyy-MM-dd HH:mm:ss"


def history_records(histories: DataFrame) -> DataFrame:
    """One row per record of each run's nested ``log_history``."""
    return (histories.select("model", F.explode("log_history").alias("r"))
            .select("model", "r.*"))


def loss_curves(records: DataFrame) -> DataFrame:
    """(model, step, kind, loss) for train (``loss``) and eval (``eval_loss``) records."""
    train = records.where(F.col("loss").isNotNull()).select(
        "model", "step", F.lit("train").alias("kind"), F.col("loss").alias("loss"))
    ev = records.where(F.col("eval_loss").isNotNull()).select(
        "model", "step", F.lit("eval").alias("kind"), F.col("eval_loss").alias("loss"))
    return train.unionByName(ev)


def _known(records: DataFrame, name: str) -> Column:
    """A numeric column of ``records`` with NaN as null; null where the records have no such column."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double")) if name in records.columns \
        else F.lit(None).cast("double")


def aligned_evaluations(records: DataFrame, eval_loss: str = "eval_loss", loss: str = "loss") -> DataFrame:
    """One row per evaluation of a model: (model, step, eval_loss, train_step, train_loss, prev_step, prev_loss).

    Histories mix records of different cadence; each evaluation gets the train record at or before its step (as-of) and
    the evaluation before it. A step logged more than once (a resumed run) counts once, with its largest loss; null and
    NaN losses are no records. The window of a model holds one row per logged step.
    """
    step = records.select("model", "step", _known(records, eval_loss).alias("_eval"), _known(records, loss).alias("_train"))
    step = (step.where(F.col("step").isNotNull()).groupBy("model", "step")
            .agg(F.max("_eval").alias("_eval"), F.max("_train").alias("_train")))
    so_far = Window.partitionBy("model").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    train = F.when(F.col("_train").isNotNull(), F.struct("step", F.col("_train").alias("loss")))
    met = step.withColumn("_at", F.last(train, ignorenulls=True).over(so_far)).where(F.col("_eval").isNotNull())
    in_order = Window.partitionBy("model").orderBy("step")
    return met.select("model", "step", F.col("_eval").alias(eval_loss), F.col("_at.step").alias("train_step"),
                      F.col("_at.loss").alias("train_loss"), F.lag("step").over(in_order).alias("prev_step"),
                      F.lag("_eval").over(in_order).alias("prev_loss"))


def _rises(loss: str) -> Column:
    return F.coalesce((F.col(loss) > F.col("prev_loss")).cast("int"), F.lit(0)).alias("overfit")


def overfit_flags(records: DataFrame, loss: str = "eval_loss") -> DataFrame:
    """1 where the eval loss rises against the previous evaluation of the model."""
    return aligned_evaluations(records, loss).select("model", "step", loss, "prev_loss", _rises(loss))


def checkpoint_rank(records: DataFrame, keep_last: int = 2, loss: str = "eval_loss") -> DataFrame:
    """Rank evaluated checkpoints by loss (best = 1) and by recency; the last ``keep_last`` are retained."""
    return _ranked(aligned_evaluations(records, loss), keep_last, loss).select(
        "model", "step", loss, "loss_rank", "recency_rank", "is_best", "is_retained")


def _ranked(evaluations: DataFrame, keep_last: int, loss: str) -> DataFrame:
    by_loss = Window.partitionBy("model").orderBy(F.col(loss), F.col("step"))
    by_step = Window.partitionBy("model").orderBy(F.col("step").desc())
    return (evaluations.withColumn("loss_rank", F.row_number().over(by_loss).cast("bigint"))
            .withColumn("recency_rank", F.row_number().over(by_step).cast("bigint"))
            .withColumn("is_best", (F.col("loss_rank") == 1).cast("int"))
            .withColumn("is_retained", (F.col("recency_rank") <= keep_last).cast("int")))


def evaluation_report(records: DataFrame, keep_last: int = 2, loss: str = "eval_loss") -> DataFrame:
    """T1-T3 on one row per evaluation: train loss beside the eval loss, their gap, the rise flag and the ranks."""
    e = _ranked(aligned_evaluations(records, loss), keep_last, loss)
    return e.select("model", "step", loss, "train_step", "train_loss",
                    F.round(F.col(loss) - F.col("train_loss"), 6).alias("gap"), "prev_loss", _rises(loss),
                    "loss_rank", "is_best", "is_retained")


def variant_compare(records: DataFrame, loss: str = "eval_loss") -> DataFrame:
    """T4: per model: final and best eval loss, their steps, the gap, the distance to the best variant, the last train
    loss, the number of logged steps, and the mean evaluation throughput when the history records it."""
    rate = "eval_samples_per_second"
    extra = [F.avg(_known(records, rate)).alias("samples_per_sec")] if rate in records.columns else []
    known = records.withColumns({"_eval": _known(records, loss), "_train": _known(records, "loss")})
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("step"))  # noqa: E731  null: no record of this kind
    best = F.when(F.col("_eval").isNotNull(), F.struct("_eval", "step"))
    g = known.groupBy("model").agg(
        F.max_by("_eval", at("_eval")).alias("final_loss"), F.max(at("_eval")).alias("final_step"),
        F.min(best).alias("_best"), F.max_by("_train", at("_train")).alias("final_train_loss"),
        F.count_distinct("step").alias("n_steps"), *extra)
    return g.select("model", "final_step", "final_loss", F.col("_best.step").alias("best_step"),
                    F.col("_best._eval").alias("best_loss"),
                    F.round(F.col("final_loss") - F.col("_best._eval"), 6).alias("final_minus_best"),
                    # against the best variant: a window over one row per model
                    F.round(F.col("_best._eval") - F.min("_best._eval").over(Window.partitionBy()), 6)
                    .alias("behind_best"),
                    "final_train_loss", "n_steps", *(["samples_per_sec"] if extra else []))


def records_of(metrics: DataFrame, names: tuple[str, ...] = ("loss", "eval_loss", "eval_samples_per_second")) -> DataFrame:
    """Records (model, step, one column per metric in ``names``) from the long form of a history."""
    picked = [F.when(F.col("metric") == m, F.col("value")).alias(m) for m in names]
    return metrics.where(F.col("metric").isin(*names)).select("model", "step", *picked)


def closing_figures(metrics: DataFrame, names: tuple[str, ...] = ("train_runtime", "total_flos", "train_loss")) -> DataFrame:
    """Per model the last value of each metric of the record that closes a run (null where it has none)."""
    return metrics.groupBy("model").agg(*[
        F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("step"))).alias(m)
        for m in names])


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Per model and metric, known or not: number of records, first and last step, extremes, mean."""
    return metrics.groupBy("model", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Structured fields of each log line (run, line_no, value); lines not in the layout are continuations."""
    v = F.col("value")
    staged = lines.select("run", "line_no", "value", v.rlike(LOG_LINE_RE).alias("_ok"))   # match once per line
    ok = F.col("_ok")
    g = lambda i: F.when(ok, F.regexp_extract(v, LOG_LINE_RE, i))
    return staged.select(
        "run", "line_no",
        g(1).alias("ts"),
        g(2).alias("level"),
        g(3).alias("component"),
        F.when(ok, (F.length(g(4)) / 2).cast("bigint")).alias("depth"),
        F.when(ok, g(5)).otherwise(v).alias("message"),
        (~ok).cast("int").alias("is_continuation"))


# How messages report an elapsed time and a count.
ELAPSED_RE = r"(\d+(?:\.\d+)?)\s*(?:s|sec|secs|seconds)\b"
_COUNTED = "(?:articles|samples|records|rows|items|questions)"
COUNT_RE = rf"\b(\d+)\s+{_COUNTED}\b"
COUNT_AFTER_RE = rf"\b{_COUNTED}:\s*(\d+)(?!\.?\d)(?!\s*(?:s|sec|secs|seconds)\b)"


def message_figures(events: DataFrame) -> DataFrame:
    """Elapsed seconds and counts that messages report, per (run, line_no); null where a message has none."""
    return events.select("run", "line_no", "component", _reported(ELAPSED_RE).cast("double").alias("elapsed_sec"),
                         _reported_count().alias("n_reported"))


def _reported(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("message", pattern, 1), F.lit(""))


def _reported_count() -> Column:
    return F.coalesce(_reported(COUNT_RE), _reported(COUNT_AFTER_RE)).cast("bigint")


def step_intervals(events: DataFrame) -> DataFrame:
    """T5: the steps of each run and component, each closed by a message that reports an elapsed time.

    A step holds the events since the one that closed the step before; what follows the last closing message is an open
    step. Columns: run, component, first_line, last_line, n_events, start_ts, end_ts, measured_sec (from the time
    stamps), reported_sec (from the closing message), n_reported (the last count that a message of the step reports),
    closed. A component that writes most of a log spans many tasks.
    """
    e = events.where(F.col("is_continuation") == 0).select(
        "run", "component", "line_no", "ts", F.to_unix_timestamp(F.col("ts"), F.lit(LOG_TS)).alias("t"),
        _reported(ELAPSED_RE).cast("double").alias("sec"), _reported_count().alias("n"))
    e = e.withColumn("_closes", F.when(F.col("sec").isNotNull(), F.col("line_no")))
    stepped = fill_forward(e, ["run", "component"], "line_no", "_closes", "_before", strict=True)
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("line_no"))
    g = stepped.groupBy("run", "component", "_before").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("n_events"),
        F.min_by("ts", "line_no").alias("start_ts"), F.max_by("ts", "line_no").alias("end_ts"),
        (F.max_by("t", "line_no") - F.min_by("t", "line_no")).alias("measured_sec"),
        F.max("sec").alias("reported_sec"), F.max_by("n", at("n")).alias("n_reported"))
    return g.drop("_before").withColumn("closed", F.col("reported_sec").isNotNull().cast("int"))


def step_report(intervals: DataFrame) -> DataFrame:
    """T5: per run and component: closed steps, measured and reported seconds, reported counts and throughput."""
    done = F.col("closed") == 1
    total = lambda c: F.sum(F.when(done, F.col(c)))
    return intervals.groupBy("run", "component").agg(
        F.count(F.when(done, 1)).alias("n_steps"), F.count(F.when(~done, 1)).alias("n_open"),
        F.sum("n_events").alias("n_events"), total("measured_sec").alias("measured_sec"),
        F.round(total("reported_sec"), 2).alias("reported_sec"), F.sum("n_reported").alias("n_reported"),
        F.round(total("n_reported") / F.nullif(total("reported_sec"), F.lit(0.0)), 6).alias("reported_per_sec"))


def step_durations(events: DataFrame) -> DataFrame:
    """T5: seconds from each log event to the next one of the same run and component, summarised."""
    e = events.where(F.col("is_continuation") == 0).select(
        "run", "component", "line_no", F.to_unix_timestamp(F.col("ts"), F.lit(LOG_TS)).alias("t"))
    nxt = lead_in_order(e, ["run", "component"], ["t", "line_no"], "t", "t_next")
    d = nxt.withColumn("dur", F.col("t_next") - F.col("t"))
    return d.groupBy("run", "component").agg(
        F.count(F.lit(1)).alias("n_events"), F.count("dur").alias("n_timed"),
        F.sum("dur").alias("total_sec"), F.round(F.avg("dur"), 6).alias("avg_sec"),
        F.max("dur").alias("max_sec"),
        F.round(F.count(F.lit(1)) / F.greatest(F.max("t") - F.min("t"), F.lit(1)), 6).alias("events_per_sec"))


def attach_continuations(parsed: DataFrame) -> DataFrame:
    """``event_line`` = the line number of the event each line belongs to
    (itself for an event line, the nearest preceding event line of the same run
    for a continuation; null for continuations before a run's first event)."""
    marked = parsed.withColumn("_ev", F.when(F.col("is_continuation") == 0, F.col("line_no")))
    return fill_forward(marked, "run", "line_no", "_ev", "event_line").drop("_ev")
