"""Written tables in the shared folder: how long plans are cut.

A staged table is plain Parquet that any executor can read again, so a lost
executor costs a re-read and never a recomputation of the history.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    # One process is driver and executor: a folder of its own, as in tests.
    folder = tempfile.mkdtemp(prefix="haulcast-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    return _written(df, new_path(df.sparkSession, label), partition_by)


@contextmanager
def staged(df: DataFrame, label: str, partition_by: str | None = None) -> Iterator[DataFrame]:
    """The same for a table that only the block needs: its files go with it."""
    path = new_path(df.sparkSession, label)
    try:
        yield _written(df, path, partition_by)
    finally:
        _delete(df.sparkSession, path)


def _written(df: DataFrame, path: str, partition_by: str | None) -> DataFrame:
    if partition_by is None:
        df.write.mode("errorifexists").parquet(path)
    else:
        # Few large files per folder; AQE cuts a folder that holds most rows into several tasks.
        laid_out = df.hint("rebalance", partition_by)
        laid_out.write.mode("errorifexists").partitionBy(partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table that ``new_path`` named."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    # The folder may lie on any file system that Spark can write to.
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
