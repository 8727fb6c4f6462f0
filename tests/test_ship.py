"""Workers that start elsewhere get the package from the driver."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {root!r})
import quarry
from quarry.operators.tfidf import TfidfModel
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
quarry.ship(spark)
print(TfidfModel.fit(spark.createDataFrame([(1, "tax audit")], "id int, text string")).terms)
"""


def test_shipped_package_is_found_by_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(Path(__file__).parents[1]))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "['audit', 'tax', 'tax audit']" in made.stdout, made.stderr[-2000:]
