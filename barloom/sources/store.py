"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession


_FOLDERS: dict[str, int] = {}  # folders made by this process


def forget(folder: str) -> None:
    """Deletes a folder of the shared store, if it is still there."""
    try:
        files, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)
    except (OSError, pa.ArrowInvalid):  # the store is gone or cannot be reached from here: nothing that can be done at the end
        pass


@atexit.register
def _forget_all() -> None:
    for folder, process in _FOLDERS.items():
        if process == os.getpid():
            forget(folder)


def until_exit(folder: str) -> str:
    """The folder, which the driver deletes when it ends: tables between steps, and what queries wrote to read again."""
    _FOLDERS[folder] = os.getpid()
    return folder


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; only a local session may lack that. It lasts
    until the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="bars-")
    return until_exit(f"{base.rstrip('/')}/bars-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read again: what is used more than once is computed once,
    and a lost executor costs no more than this step."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """df as a table bucketed by `keys` and sorted within buckets, in the shared folder; the table, read.

    One file a bucket, however many keys there are. What groups, joins or runs windows by these keys reads it without an
    exchange. An existing table of that name is replaced.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*order).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
