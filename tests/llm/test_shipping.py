"""Tasks run where the package isn't installed: functions and models travel with them."""

import os
import subprocess
import sys
from pathlib import Path


ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def missing(_):
    try:
        import caseweave
    except ModuleNotFoundError:
        yield 1
assert sum(spark.sparkContext.parallelize([0], 1).mapPartitions(missing).collect()) == 1
for name, q in entry.queries().items():
    if name[:3] in ("op1", "op3", "op4", "op7", "op8", "op9"):
        print(name, q(spark, {sf!r}).count())
"""


def test_queries_without_the_package_on_executors(sf_dir, tmp_path):
    code = SCRIPT.format(root=str(ROOT), sf=sf_dir)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # workers inherit it, and would find the package there
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) >= 12
