"""Python kernels on workers that cannot find the package by themselves."""

import os
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", entry.queries()["ncf_forward"](spark, "/root/testdata/sf0.001").count(), entry.queries()["vec_recommend"](spark, "/root/testdata/sf0.001").count())
"""


def test_kernels_run_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = done.stdout.split("rows")[1].split()
    assert int(counts[0]) > 0 and int(counts[1]) > 0
