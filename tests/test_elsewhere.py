"""Python tasks must not need the package on the workers' path: run from another folder, without PYTHONPATH."""

import os
import subprocess
import sys
from pathlib import Path

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {str(ENTRY)!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
for name in ("quota_gate", "target_path", "expanding_pct_rank", "deflated_probability"):
    print("COUNT", name, m.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_python_tasks_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert out.stdout.count("COUNT") == 4, out.stderr[-2000:]
