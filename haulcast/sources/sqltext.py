"""Stored SQL texts run with named parameters."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession


def load(name: str) -> str:
    return (resources.files("haulcast") / "sql" / f"{name}.sql").read_text(encoding="utf-8")


def run(spark: SparkSession, name: str, args: dict[str, object] | None = None, **tables: DataFrame) -> DataFrame:
    """Run ``sql/<name>.sql``; ``{table}`` marks a frame and ``:name`` a value."""
    return spark.sql(load(name), args=args, **tables)
