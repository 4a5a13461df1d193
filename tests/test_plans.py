"""Plan-shape checks: expensive expressions run once per row, scans are pruned,
no Python in the native paths, no cartesian products."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001


def _plan(spark, name):
    return E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


def test_cleaning_regexes_once(spark):
    plan = _plan(spark, "training_samples")
    assert plan.count("RLIKE(") == 3            # URL, e-mail, phone: one evaluation each
    assert plan.count("split(text") == 1
    assert "Python" not in plan


def test_page_noise_strip_once(spark):
    plan = _plan(spark, "page_articles")
    assert plan.count("<script") == 1
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan


def test_tokenizer_once_per_text(spark):
    # question and answer tokens: one regex pass each
    from papyra.operators import lm
    from papyra.plans import views
    from pyspark.sql import functions as F
    q = views.qna(spark, SF001)
    seq = q.select("id", lm.tokens(F.col("question")).alias("_q"))
    pos = lm.positions(seq, ["id"], F.col("_q"))
    assert pos._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(lower(") == 1


@pytest.mark.parametrize("name", ["qna_grid", "prompt_grid", "bertscore_pairs", "masked_nll", "step_durations"])
def test_no_cartesian(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scale_conf_bounds():
    from papyra.session import scale_conf
    big = scale_conf(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 16 * 8000          # capped at 16 waves
    small = scale_conf(10 * 2**20, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 128              # at least 2 waves
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_paragraph_report_regexes_once(spark):
    assert _plan(spark, "clean_paragraphs").count("RLIKE(") == 3
