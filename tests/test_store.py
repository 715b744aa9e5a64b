import subprocess
import sys
from pathlib import Path

from barloom.sources import store

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from barloom.sources.store import shared_folder, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert stored(spark.range(5)).count() == 5
import os
assert any(x.startswith("bars-") for x in os.listdir(sys.argv[1].removeprefix("file://")))
"""


def test_tables_between_steps_are_gone_when_the_driver_ends(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT, f"file://{tmp_path}"], check=True, capture_output=True, cwd=Path(__file__).resolve().parents[1])
    assert not list(tmp_path.glob("bars-*"))


def test_forgetting_what_is_not_there_does_nothing(tmp_path):
    store.forget(str(tmp_path / "none"))
    store.forget("nonsense://x/y")
