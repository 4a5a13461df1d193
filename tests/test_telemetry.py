"""Run telemetry."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import telemetry as T
from papyra.operators.ranking import lead_in_order


def test_overfit_and_best(spark):
    c = spark.createDataFrame([("FT_full", 1, 2.1123), ("FT_full", 2, 2.1126), ("FT_full", 3, 2.1112)],
                              "model string, step bigint, eval_loss double")
    flags = [r["overfit"] for r in T.overfit_flags(c).orderBy("step").collect()]
    assert flags == [0, 1, 0]
    rk = {r["step"]: r for r in T.checkpoint_rank(c).collect()}
    assert rk[3]["is_best"] == 1 and rk[3]["is_retained"] == 1 and rk[2]["is_retained"] == 1
    assert rk[1]["is_retained"] == 0
    v = T.variant_compare(c).first()
    assert v["final_step"] == 3 and v["best_step"] == 3 and v["final_minus_best"] == 0.0


def test_log_parse(spark):
    lines = spark.createDataFrame([("r", 0, "[2026-02-24 10:00:00] [ INFO  ] [    data_prepare    ]   Omitting x"),
                                   ("r", 1, "    continued text"),
                                   ("r", 2, "[2026-02-24 10:00:05] [WARNING] [   E2E workflow     ] Unknown step")],
                                  "run string, line_no bigint, value string")
    p = {r["line_no"]: r for r in T.parse_log(lines).collect()}
    assert p[0]["level"] == "INFO" and p[0]["component"] == "data_prepare" and p[0]["depth"] == 1
    assert p[0]["message"] == "Omitting x" and p[1]["is_continuation"] == 1
    assert p[2]["component"] == "E2E workflow" and p[2]["depth"] == 0
    assert sum(r["is_continuation"] for r in p.values()) == 1


def test_history_records_from_json(spark, tmp_dir):
    import os
    from papyra.sources.readers import read_run_histories
    for model, losses in {"FT_full": [2.1123, 2.1126, 2.1112], "FT-M1B": [2.2, 2.15, 2.1343]}.items():
        d = os.path.join(tmp_dir, "run", model, "checkpoint-1100")
        os.makedirs(d)
        hist = [{"epoch": i + 1.0, "step": 110 * (i + 1), "loss": 2.5 - i * 0.1} for i in range(3)]
        hist += [{"epoch": i + 1.0, "step": 110 * (i + 1), "eval_loss": v, "eval_samples_per_second": 35.0}
                 for i, v in enumerate(losses)]
        with open(os.path.join(d, "trainer_state.json"), "w") as f:
            json.dump({"log_history": hist, "global_step": 330, "max_steps": 330}, f)
    os.makedirs(os.path.join(tmp_dir, "run", "script_dump"))
    h = read_run_histories(spark, os.path.join(tmp_dir, "run"))
    curves = T.loss_curves(T.history_records(h))
    assert curves.where("kind = 'eval'").count() == 6 and curves.where("kind = 'train'").count() == 6
    every = T.history_records(h)
    cmp = {r["model"]: r for r in T.variant_compare(every).collect()}
    assert cmp["FT_full"]["final_loss"] == 2.1112 and cmp["FT_full"]["samples_per_sec"] == 35.0
    assert abs(cmp["FT_full"]["final_train_loss"] - 2.3) < 1e-12 and cmp["FT_full"]["n_steps"] == 3
    flags = {r["step"]: r["overfit"] for r in T.overfit_flags(every.where("model = 'FT_full'")).collect()}
    assert flags == {110: 0, 220: 1, 330: 0}


# train records every 4 steps, evaluations at 10, 20 and 33, a closing record; one evaluation has no number
MIXED = ([{"step": s, "epoch": s / 10, "loss": 3.0 - s / 100, "grad_norm": 1.0} for s in range(4, 33, 4)]
         + [{"step": 10, "epoch": 1.0, "eval_loss": 2.2, "eval_samples_per_second": 30.0},
            {"step": 20, "epoch": 2.0, "eval_loss": 2.3, "eval_samples_per_second": 40.0},
            {"step": 25, "epoch": 2.5, "eval_loss": None}, {"step": 33, "epoch": 3.3, "eval_loss": 2.25}]
         + [{"step": 33, "epoch": 3.3, "train_runtime": 584.0, "total_flos": 1.766e16, "train_loss": 1.9, "my_metric": 7,
             "done": True}])


def _history(root, model, checkpoint, records):
    import os
    d = os.path.join(root, model, f"checkpoint-{checkpoint}")
    os.makedirs(d)
    with open(os.path.join(d, "trainer_state.json"), "w") as f:
        json.dump({"log_history": records, "global_step": checkpoint, "max_steps": 33}, f, indent=1)


def test_mixed_history(spark, tmp_dir):
    """Evaluations and train records at steps of their own, in one unfiltered table."""
    from papyra.sources.readers import read_history_metrics, read_run_histories
    _history(tmp_dir, "FT full+", 33, MIXED)
    _history(tmp_dir, "FT full+", 20, MIXED[:7])          # an earlier checkpoint repeats records
    _history(tmp_dir, "only-train", 33, MIXED[:8])
    _history(tmp_dir, "script_dump", 33, MIXED)
    wide = T.history_records(read_run_histories(spark, tmp_dir).where("checkpoint = 33"))
    metrics = read_history_metrics(spark, tmp_dir)
    assert {r["model"] for r in metrics.select("model").distinct().collect()} == {"FT full+", "only-train"}
    for records in (wide, T.records_of(metrics)):
        got = {r["step"]: r for r in T.evaluation_report(records).collect()}
        assert sorted(got) == [10, 20, 33]
        assert {s: r["overfit"] for s, r in got.items()} == {10: 0, 20: 1, 33: 0}
        assert {s: r["train_step"] for s, r in got.items()} == {10: 8, 20: 20, 33: 32}
        assert {s: round(r["train_loss"], 6) for s, r in got.items()} == {10: 2.92, 20: 2.8, 33: 2.68}
        assert [s for s, r in got.items() if r["is_best"]] == [10] and [r["loss_rank"] for _, r in sorted(got.items())] == [1, 3, 2]
        assert {s for s, r in got.items() if r["is_retained"]} == {20, 33}
        assert {r["step"]: r["overfit"] for r in T.overfit_flags(records).collect()} == {10: 0, 20: 1, 33: 0}
        assert {r["step"]: r["is_best"] for r in T.checkpoint_rank(records).collect()} == {10: 1, 20: 0, 33: 0}
        v = {r["model"]: r for r in T.variant_compare(records).collect()}
        full = v["FT full+"]
        assert (full["final_loss"], full["final_step"], full["best_loss"], full["best_step"]) == (2.25, 33, 2.2, 10)
        assert full["final_minus_best"] == 0.05 and round(full["final_train_loss"], 6) == 2.68 and full["samples_per_sec"] == 35.0
        assert v["only-train"]["best_loss"] is None and round(v["only-train"]["final_train_loss"], 6) == 2.68


def test_metrics_that_nobody_declared(spark, tmp_dir):
    from papyra.sources.readers import read_history_metrics
    _history(tmp_dir, "m", 33, MIXED)
    m = read_history_metrics(spark, tmp_dir)
    by = {r["metric"]: r for r in T.metric_summary(m).collect()}
    assert by["my_metric"]["most"] == 7.0 and by["total_flos"]["most"] == 1.766e16 and by["loss"]["n"] == 8
    assert by["done"]["most"] is None
    assert m.where("metric = 'done'").first()["value_text"] == "true"
    end = T.closing_figures(m).first()
    assert (end["train_runtime"], end["total_flos"], end["train_loss"]) == (584.0, 1.766e16, 1.9)


def test_histories_written_by_spark(spark, tmp_dir):
    """Models whose names need escaping in a path, and no file at all."""
    from papyra.sources.readers import read_history_metrics
    rows = [(m, 33, json.dumps({"log_history": [{"step": 1, "loss": 1.5}]})) for m in ("a/b c", "FT=1", "x+y %20")]
    (spark.createDataFrame(rows, "model string, checkpoint int, value string").write.partitionBy("model", "checkpoint")
     .text(f"{tmp_dir}/h"))
    got = read_history_metrics(spark, f"{tmp_dir}/h", "part-*").collect()
    assert {(r["model"], r["checkpoint"], r["value"]) for r in got} == {("a/b c", 33, 1.5), ("FT=1", 33, 1.5), ("x+y %20", 33, 1.5)}


def test_step_intervals(spark):
    said = ["Start crawling articles...", "Total loaded articles: 12", "Elapsed time for crawling articles: 5.50 seconds",
            "Start preprocessing", "  more", "Finished preprocessing articles. Total time: 0.33 seconds. Omitted 3 articles with empty text.",
            "Start again"]
    head = "[2026-02-24 10:00:{:02d}] [ INFO  ] [ {} ] {}"
    lines = [("r", i, head.format(2 * i, "c", m)) for i, m in enumerate(said)] + [("r", 100, head.format(50, "d", "alone"))]
    lines += [("r", 7, "continued 9 seconds")]
    parsed = T.parse_log(spark.createDataFrame(lines, "run string, line_no bigint, value string"))
    steps = T.step_intervals(parsed)
    got = {(r["component"], r["first_line"]): r for r in steps.collect()}
    assert sorted(got) == [("c", 0), ("c", 3), ("c", 6), ("d", 100)]
    one, two = got["c", 0], got["c", 3]
    assert (one["last_line"], one["n_events"], one["measured_sec"], one["reported_sec"], one["n_reported"], one["closed"]) == (
        2, 3, 4, 5.5, 12, 1)
    assert (two["reported_sec"], two["n_reported"], two["measured_sec"]) == (0.33, 3, 4)
    assert got["c", 6]["closed"] == 0 and got["c", 6]["reported_sec"] is None
    report = {r["component"]: r for r in T.step_report(steps).collect()}
    assert (report["c"]["n_steps"], report["c"]["n_open"], report["c"]["reported_sec"]) == (2, 1, 5.83)
    assert report["c"]["n_reported"] == 15 and report["d"]["n_steps"] == 0 and report["d"]["reported_per_sec"] is None


def test_lead_in_order_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 7).cast("string")).alias("k"), (F.col("id") * 13 % 5003).alias("t"))
    got = lead_in_order(df, ["k"], ["t"], "t", "nt", n_parts=16)
    ref = df.withColumn("rt", F.lead("t").over(Window.partitionBy("k").orderBy("t")))
    j = got.join(ref, ["k", "t"])
    assert j.count() == 5000
    assert j.where(~F.col("nt").eqNullSafe(F.col("rt"))).count() == 0


def test_attach_continuations_across_pieces(spark):
    from papyra.operators.ranking import fill_forward
    rows = [(0, "  orphan"), (1, "[2026-02-24 10:00:00] [ INFO  ] [ c ] a"), (2, "  more"), (3, "  more"),
            (4, "[2026-02-24 10:00:01] [ INFO  ] [ c ] b"), (5, "  tail")]
    # a second run: its orphan line does not join the first run's last event
    lines = spark.createDataFrame([("a", *r) for r in rows] + [("b", 10, "  orphan"), ("b", 11, rows[1][1])],
                                  "run string, line_no bigint, value string")
    parsed = T.parse_log(lines)
    got = {r["line_no"]: r["event_line"] for r in T.attach_continuations(parsed).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 10: None, 11: 11}
    took = {(r["run"], r["component"]): (r["n_events"], r["total_sec"]) for r in T.step_durations(parsed).collect()}
    assert took == {("a", "c"): (2, 1), ("b", "c"): (1, None)}
    # many pieces, long gaps: equals the single-window answer
    df = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 97 == 5, F.col("id")).alias("v"))
    got = fill_forward(df, "k", "o", "v", "f", n_parts=16)
    ref = df.withColumn("r", F.last("v", ignorenulls=True).over(
        Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    assert got.join(ref, "o").where(~F.col("f").eqNullSafe(F.col("r"))).count() == 0


def test_message_figures(spark):
    lines = spark.createDataFrame([("r", 0, "[2026-02-24 10:00:00] [ INFO  ] [ c ] stored 14 articles in 2.5 seconds"),
                                   ("r", 1, "[2026-02-24 10:00:00] [ INFO  ] [ c ] started")],
                                  "run string, line_no bigint, value string")
    got = {r["line_no"]: (r["elapsed_sec"], r["n_reported"]) for r in T.message_figures(T.parse_log(lines)).collect()}
    assert got == {0: (2.5, 14), 1: (None, None)}
