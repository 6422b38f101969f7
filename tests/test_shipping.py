import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from conjunx.suite import QUERIES
print("rows", QUERIES["paged_round_trip"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_path_of_ours(tmp_path):
    """The package is on the driver's path only."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(Path(__file__).parents[1])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 25" in done.stdout, done.stderr[-2000:]
