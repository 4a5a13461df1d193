"""Session and shared-storage helpers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``papyra`` importable in Python workers (``--py-files`` equivalent).

    The package is zipped once per application and added with
    ``SparkContext.addPyFile``, which copies it to every executor; the Arrow
    UDF paths import their helpers from it.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="papyra-pyfiles-"), "papyra.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "papyra", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Taken from the session (``spark.checkpoint.dir`` or the context's checkpoint
    dir). Only a local-mode session without one gets a fresh temporary folder;
    a cluster session must name a shared folder itself.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
        d = tempfile.mkdtemp(prefix="papyra-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark)
    # getCheckpointDir() already points at an app-unique subfolder
    return f"{root}/papyra/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for driver-side file access in local tests."""
    return path[len("file:"):] if path.startswith("file:") else path


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def materialize(df, name: str):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used where a result feeds several actions (an exact count and a rank, a
    fit and its totals): the work runs once, and the lineage is cut at a
    durable table, so a lost executor does not recompute the whole chain.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return balanced(spark.read.parquet(path))


def balanced(df, min_partitions: int | None = None):
    """Spread a scan with fewer splits than the session's parallelism.

    Only small inputs (fewer splits than cores, e.g. one parquet row group)
    are shuffled, which is cheap by construction; large inputs keep their
    scan partitioning and are never reshuffled here.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20,
               text_batch_rows: int = 2000) -> dict[str, str]:
    """Session settings for a cluster run over ``input_bytes`` of input.

    Shuffle partitions are sized for about ``partition_bytes`` of input each,
    between two and sixteen waves of cores (shuffled data is usually much
    smaller than the input, and block metadata grows with map x reduce
    partitions); AQE coalesces small ones and splits skewed ones at run time.
    Arrow batches are capped in rows because a row may hold a long document.
    """
    parts = min(16 * total_cores, max(2 * total_cores, math.ceil(input_bytes / partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(text_batch_rows),
    }
