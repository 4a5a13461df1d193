"""The driver may import __spark_entry__ by path from another directory: the
Python workers must still import the package (shipped with addPyFile)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("spark_entry", {os.path.join(REPO, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
print("ROWS", E.queries()["map_batches"](spark, "/root/testdata/sf0.001").count())
"""


def test_udf_query_from_foreign_directory():
    cwd = tempfile.mkdtemp(prefix="papyra-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    assert "ROWS 172" in r.stdout, r.stderr[-2000:]
