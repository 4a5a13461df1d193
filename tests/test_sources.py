"""Sources and sinks (S1-S4, S6, S8) on small written files."""

import json
import os

import pytest
from pyspark.sql import functions as F


def test_read_qna_prefers_lowercase(spark, tmp_dir):
    from papyra.sources.readers import read_qna
    with open(os.path.join(tmp_dir, "QnA.jsonl"), "w") as f:
        f.write(json.dumps({"id": 1, "question": "upper?", "answer": "U"}) + "\n\n")
    assert [r["question"] for r in read_qna(spark, tmp_dir).collect()] == ["upper?"]
    with open(os.path.join(tmp_dir, "qna.jsonl"), "w") as f:
        f.write(json.dumps({"id": 2, "question": "lower?", "answer": "ä ö"}, ensure_ascii=False) + "\n")
    assert [(r["id"], r["answer"]) for r in read_qna(spark, tmp_dir).collect()] == [(2, "ä ö")]


def test_read_prompts_keeps_blanks_and_order(spark, tmp_dir):
    from papyra.sources.readers import read_prompts
    p = os.path.join(tmp_dir, "prompt.txt")
    with open(p, "w") as f:
        f.write('  "first" \\n literal\n\nthird\t\n')
    got = [r["prompt"] for r in read_prompts(spark, p).orderBy("prompt_pos").collect()]
    assert got == ['"first" \\n literal', "", "third"]


def test_read_samples_json(spark, tmp_dir):
    from papyra.sources.readers import read_samples
    p = os.path.join(tmp_dir, "proc.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"idx": 3, "article_id": "a", "x": "<TITLE>: t"}) + "\n")
    assert read_samples(spark, p).first()["x"] == "<TITLE>: t"


def test_failfast_raises_on_corrupt_line(spark, tmp_dir):
    from papyra.sources.readers import read_raw_articles
    p = os.path.join(tmp_dir, "raw.jsonl")
    with open(p, "w") as f:
        f.write('{"idx": 1, "text": ["a"]}\n{"idx":4\n')
    with pytest.raises(Exception):
        read_raw_articles(spark, p, mode="FAILFAST").select("idx", "text").collect()


def test_strict_dates_raise(spark):
    from papyra.operators.extract import page_articles
    pages = spark.createDataFrame([(1, "https://h/", "<h1>T</h1><time>31.02.2026</time><article><p>x</p></article>")],
                                  "page_id bigint, url string, html string")
    assert page_articles(pages).first()["date_malformed"] == 1
    with pytest.raises(Exception, match="malformed article date"):
        page_articles(pages, strict_dates=True).collect()


def test_raw_jsonl_round_trip_kinds(spark, tmp_dir):
    from papyra.plans import views
    from papyra.sources.readers import read_raw_articles, text_kind, well_formed
    from tests.conftest import SF001
    views.raw_article_json(spark, SF001).write.text(f"{tmp_dir}/raw")
    raw = well_formed(read_raw_articles(spark, f"{tmp_dir}/raw"))
    kinds = {r["k"] for r in raw.select(text_kind(F.col("text")).alias("k")).collect()}
    assert kinds <= {"ARRAY<STRING>", "STRING", "VOID"} and "ARRAY<STRING>" in kinds


def test_read_qna_raises_other_errors(spark, tmp_dir):
    """Only a missing file falls back to the other spelling."""
    from pyspark.errors import AnalysisException

    from papyra.sources import readers
    with open(os.path.join(tmp_dir, "QnA.jsonl"), "w") as f:
        f.write(json.dumps({"id": 1, "question": "q", "answer": "a"}))
    known = readers.QNA_DDL
    try:
        readers.QNA_DDL = "id BIGINT, id BIGINT"          # an ambiguous schema, whatever the file's name
        with pytest.raises(AnalysisException):
            readers.read_qna(spark, tmp_dir).collect()
    finally:
        readers.QNA_DDL = known


def _write_lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write("".join(x + "\n" for x in lines))


def test_line_numbers_over_many_splits_and_files(spark, tmp_dir):
    from papyra.sources.readers import numbered_lines
    files = {f"run{r}/log.{i}": [f"{r}-{i}-{k} " + "x" * (k % 50) if k % 17 else "" for k in range(300 + 40 * i)]
             for r in range(2) for i in range(3)}
    for name, lines in files.items():
        _write_lines(os.path.join(tmp_dir, name), lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    try:
        got = numbered_lines(spark, f"{tmp_dir}/*")
        assert spark.read.text(f"{tmp_dir}/*").rdd.getNumPartitions() > 50
        found = {}
        for r in got.collect():
            found.setdefault(r["file"].split(tmp_dir + "/")[1], []).append((r["line_no"], r["value"]))
        assert {n: [v for _, v in sorted(x)] for n, x in found.items()} == files
        assert all(sorted(k for k, _ in x) == list(range(len(x))) for x in found.values())
        whole = {}
        for r in numbered_lines(spark, f"{tmp_dir}/*", by_folder=True).collect():
            whole.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["line_no"], r["value"]))
        assert {n: [v for _, v in sorted(x)] for n, x in whole.items()} == {
            f"run{r}": [v for i in range(3) for v in files[f"run{r}/log.{i}"]] for r in range(2)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_of_no_lines(spark, tmp_dir):
    from papyra.sources.readers import numbered_lines, read_prompts
    _write_lines(os.path.join(tmp_dir, "empty.txt"), [])
    assert numbered_lines(spark, f"{tmp_dir}/empty.txt").count() == 0
    _write_lines(os.path.join(tmp_dir, "blank.txt"), ["", " ", ""])
    assert [r["prompt"] for r in read_prompts(spark, f"{tmp_dir}/blank.txt").orderBy("prompt_pos").collect()] == ["", "", ""]
