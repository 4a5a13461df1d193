"""Sources: stored tables, raw/processed article JSONL, Q&A, prompts, run histories, logs.

Readers declare schemas instead of inferring them, so a scan never needs an
extra pass over the data and column pruning reaches the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.session import table_path

RAW_ARTICLE_DDL = ("idx BIGINT, title STRING, article_id STRING, url STRING, date_raw STRING, "
                   "category STRING, teaser STRING, text VARIANT")
SAMPLE_DDL = "idx BIGINT, article_id STRING, x STRING"
QNA_DDL = "id BIGINT, question STRING, answer STRING"
CORRUPT_COL = "_corrupt_record"

HISTORY_RECORD = T.StructType([
    T.StructField("epoch", T.DoubleType()), T.StructField("step", T.LongType()),
    T.StructField("loss", T.DoubleType()), T.StructField("grad_norm", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()), T.StructField("eval_loss", T.DoubleType()),
    T.StructField("eval_runtime", T.DoubleType()),
    T.StructField("eval_samples_per_second", T.DoubleType()),
    T.StructField("eval_steps_per_second", T.DoubleType()),
])
RUN_HISTORY = T.StructType([
    T.StructField("log_history", T.ArrayType(HISTORY_RECORD)),
    T.StructField("global_step", T.LongType()), T.StructField("max_steps", T.LongType()),
])


# tables whose rows carry long text: per-row work dominates, so a scan with
# fewer splits than cores is rebalanced (see ``session.balanced``)
TEXT_TABLES = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Parquet table of the stored dataset; selecting ``cols`` prunes the scan."""
    from papyra.session import balanced
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*cols) if cols else df
    return balanced(df) if name in TEXT_TABLES else df


def read_raw_articles(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Raw article JSONL; blank lines skipped; ``text`` kept as VARIANT.

    ``mode="FAILFAST"`` raises on a malformed line (reference behaviour); the
    default quarantines it in ``_corrupt_record`` (see ``quarantined``).
    """
    reader = spark.read.schema(f"{RAW_ARTICLE_DDL}, {CORRUPT_COL} STRING").option("mode", mode)
    if mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COL)
    return reader.json(path)


def well_formed(raw: DataFrame) -> DataFrame:
    return raw.where(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL)


def quarantined(raw: DataFrame) -> DataFrame:
    """Malformed lines (the scan must read a parsed column besides the corrupt-record one)."""
    return raw.where(F.col(CORRUPT_COL).isNotNull()).select("idx", CORRUPT_COL)


def text_kind(text_variant) -> F.Column:
    """ARRAY<STRING> / STRING / VOID (JSON null) / NULL (field absent)."""
    return F.coalesce(F.schema_of_variant(text_variant), F.lit("NULL"))


def normalise_text(raw: DataFrame, body_mode: str = "lines") -> DataFrame:
    """Raw ``text`` (list | str | null) -> ``text ARRAY<STRING>`` plus ``text_kind``.

    ``body_mode="lines"`` turns a string body into its lines; ``"chars"``
    reproduces iterating the string per character (reference parity).
    """
    v = F.col("text")
    kind = text_kind(v)
    as_str = F.try_variant_get(v, "$", "string")
    arr = F.try_variant_get(v, "$", "array<string>")
    if body_mode == "chars":
        str_body = F.when(as_str == "", F.array().cast("array<string>")).otherwise(F.split(as_str, ""))
    else:
        str_body = F.split(as_str, "\n")
    body = (F.when(kind.startswith("ARRAY"), arr)
            .when(kind == "STRING", str_body))
    return raw.withColumn("text_kind", kind).withColumn("text", body)


def read_samples(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Processed training samples (idx, article_id, x)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(SAMPLE_DDL).json(path)


def read_qna(spark: SparkSession, prompt_dir: str) -> DataFrame:
    """S3: Q&A JSONL (``qna.jsonl`` preferred over ``QnA.jsonl``), blank lines skipped.

    Existence is checked by Spark itself, so any file system Spark reads works; any other error is raised.
    """
    from pyspark.errors import AnalysisException
    reader = spark.read.schema(QNA_DDL).option("mode", "FAILFAST")
    try:
        return reader.json(f"{prompt_dir}/qna.jsonl")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return reader.json(f"{prompt_dir}/QnA.jsonl")


def numbered_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Text lines with their position from 0: (file, line_no, value), for files of any number of splits.

    A split's lines are numbered in reading order, and the lines of the splits before it are added: one row per split is
    grouped and summed, and no line is sorted or moved to be numbered. ``by_folder`` numbers through all files of a
    folder in the order of their names (rotated logs, part files), and ``file`` is the folder.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value")
    folder = F.regexp_replace("_path", "/[^/]*$", "")
    splits = lines.groupBy("_path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = splits.withColumn("file", folder if by_folder else F.col("_path"))
    before = Window.partitionBy("file").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (lines.join(splits.select("_path", "_block", "file", "_first", "_before"), ["_path", "_block"])
            .select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt per line, stripped, blank lines kept; ``prompt_pos`` is the line's position in its file."""
    from papyra.functions.text import py_strip
    lines = numbered_lines(spark, path)
    return lines.select("file", F.col("line_no").alias("prompt_pos"), py_strip(F.col("value")).alias("prompt"))


# a run's history lies at <model>/checkpoint-<n>/trainer_state.json, or below model=<model>/checkpoint=<n>/ when Spark
# wrote it; group 1 is the model, group 2 the checkpoint
HISTORY_PATH_RE = "/(?:model=)?([^/]+)/checkpoint[-=]([0-9]+)/[^/]+$"


def _history_files(reader, root: str, name: str) -> DataFrame:
    """Files of run histories below ``root`` with their model and checkpoint; ``script_dump`` folders are skipped."""
    df = (reader.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root))
    path = F.col("_metadata.file_path")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # noqa: E731  a plus sign is no space in a path
    model = plain(F.regexp_extract(path, HISTORY_PATH_RE, 1))
    return (df.withColumn("model", F.when(path.contains("/model="), plain(model)).otherwise(model))   # Spark escapes again
            .withColumn("checkpoint", F.regexp_extract(path, HISTORY_PATH_RE, 2).try_cast("bigint"))
            .where(~path.contains("/script_dump/")))


def read_run_histories(spark: SparkSession, root: str, name: str = "trainer_state.json") -> DataFrame:
    """One history file per checkpoint of a model, with the typed fields of ``RUN_HISTORY``."""
    return _history_files(spark.read.schema(RUN_HISTORY), root, name)


def read_history_metrics(spark: SparkSession, root: str, name: str = "trainer_state.json") -> DataFrame:
    """S8 in long form: (model, checkpoint, record, step, epoch, metric, value, value_text), one row per key of a record.

    The files are read as VARIANT, so metrics that nobody declared (run time, flops, a loss of one's own) are kept;
    ``value`` is null and ``value_text`` holds the JSON where a metric is not a number. Only the history of a model's
    last checkpoint counts: a later file repeats the records of the earlier ones. ``record`` is the position in it.
    """
    files = _history_files(spark.read.option("singleVariantColumn", "v"), root, name)
    last = Window.partitionBy("model").orderBy(F.desc("checkpoint"))        # a row per file
    files = files.withColumn("_n", F.rank().over(last)).where("_n = 1")
    records = files.select("model", "checkpoint", F.posexplode(
        F.try_variant_get("v", "$.log_history", "array<variant>")).alias("record", "r"))
    as_type = lambda c, p, t: F.try_variant_get(c, p, t)
    pairs = records.select("model", "checkpoint", F.col("record").cast("bigint").alias("record"),
                           as_type("r", "$.step", "bigint").alias("step"), as_type("r", "$.epoch", "double").alias("epoch"),
                           F.explode(as_type("r", "$", "map<string,variant>")).alias("metric", "m"))
    number = F.when(F.schema_of_variant("m").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), as_type("m", "$", "double"))
    return pairs.where(~F.col("metric").isin("step", "epoch")).select(
        "model", "checkpoint", "record", "step", "epoch", "metric", number.alias("value"),
        F.when(number.isNull(), F.to_json("m")).alias("value_text"))


def read_log_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """S9 source: plain log text; a file is a run, or with ``by_folder`` a folder of rotated files. Parse with
    ``operators.telemetry.parse_log``."""
    return numbered_lines(spark, path, by_folder).select(F.col("file").alias("run"), "value", "line_no")
