import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from topicloom.operators.pages import page_text
from topicloom.session import ship_package
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship_package(spark)
ship_package(spark)
pages = spark.createDataFrame([(1, "<p>a<p>b")], "page_id long, html string")
print("TEXT", page_text(pages).first().text)
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, timeout=180,
        capture_output=True, text=True,
    )
    assert "TEXT a b" in done.stdout, done.stderr[-2000:]
