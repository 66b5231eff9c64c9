"""Versions of a table set, published whole.

A save writes all its tables into a folder of its own and then appends one row
to the list of versions. Readers take the last row of that list, so they see a
version only once all of it is there; a save that breaks off leaves the one
before as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

VERSIONS = "number bigint, folder string"


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _last(spark: SparkSession, path: str):
    """The latest version; of two saves that ran at once, the one of the larger folder name."""
    listed = _versions(spark, path)
    return None if listed is None else listed.orderBy("number", "folder", ascending=False).first()


def publish(spark: SparkSession, path: str, tables: Mapping[str, DataFrame]) -> str:
    """Write ``tables`` as the next version and return its folder."""
    folder = f"{path}/version-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    before = _last(spark, path)
    number = 1 if before is None else before.number + 1
    spark.createDataFrame([(number, folder)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return folder


def current(spark: SparkSession, path: str) -> str:
    """Folder of the version to read."""
    last = _last(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing has been published under {path}")
    return last.folder
