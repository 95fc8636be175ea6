"""The package reaches the workers whatever folder the driver was started from."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", %r)
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tagwise.operators.vectors import chunk_and_embed
df = spark.createDataFrame([("1", "a b c"), ("2", ""), ("3", None)], "id string, t string")
print("ROWS", sorted((r.id, r.chunk_no, r.n_words) for r in chunk_and_embed(df, "t").collect()))
"""


def test_map_in_pandas_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYSPARK_PYTHON": sys.executable}
    script = tmp_path / "job.py"
    script.write_text(JOB % os.path.join(ROOT, "__spark_entry__.py"))
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [('1', 0, 3), ('2', 0, 0), ('3', 0, 0)]" in out.stdout, out.stderr[-2000:]
