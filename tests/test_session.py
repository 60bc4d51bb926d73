import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from seqloom.operators.records import parse_records
from seqloom.session import ship
ship(spark)
ship(spark)
lines = spark.createDataFrame([(1, 1, "a,0")], "line_id long, file_id long, raw string")
files = spark.createDataFrame([(1, "text,label")], "file_id long, header string")
print("ROWS", parse_records(lines, files).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver alone has the package on its path, and runs in another folder."""
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]
