"""CSV, JSON and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from haulcast import schemas


#: One rule for writing and reading: quotes doubled, blanks and line breaks kept, six places of a second.
#: NULL is an empty cell and an empty text is a quoted one.
CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "quoteAll": "false",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "multiLine": "true",
    "mode": "FAILFAST",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
#: The reader gives an empty cell this mark, which no text has, and so tells it from a quoted empty text.
READ_EMPTY = {"nullValue": "\u0001null\u0001", "emptyValue": ""}
JSON_TIMES = {k: v for k, v in CSV.items() if k.startswith("timestamp")}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, as ``write_csv`` writes it: columns are found by name, unreadable rows fail.

    The header alone is read first; every column is then taken as text by its
    place in the file and converted by name.
    """
    names = spark.read.options(**{**CSV, "header": "false"}).csv(path).first() if _has_rows(spark, path) else []
    there = list(names or [])
    if missing := [f.name for f in schema.fields if f.name not in there]:
        raise ValueError(f"no column {missing} in {path}")
    kinds = {f.name: f.dataType for f in schema.fields}
    found = T.StructType([T.StructField(n, kinds.get(n, T.StringType()), True) for n in there])
    return spark.read.schema(found).options(**CSV, **READ_EMPTY, enforceSchema="false").csv(path).select([f"`{f.name}`" for f in schema.fields])


def _has_rows(spark: SparkSession, path: str) -> bool:
    return not spark.read.text(path).isEmpty()


def read_forecast_csv(spark: SparkSession, path: str) -> DataFrame:
    """Forecast table as exported: nine columns, no header."""
    return spark.read.schema(schemas.VOLUME_FORECAST).option("header", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV, nullValue="", emptyValue='""').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Stage as JSON lines with ISO dates and six places of a second."""
    df.write.mode("overwrite").options(ignoreNullFields="false", **JSON_TIMES).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**JSON_TIMES).json(path)


def write_matrix(matrix: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Forecast matrix sink, as Parquet or as CSV with a header."""
    writer = matrix.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_matrix(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def write_history(df: DataFrame, path: str, day: str = "ship_date") -> None:
    """Shipment history partitioned by day, so date windows prune files.

    The rebalance lays rows out by day and cuts a hot day into several tasks.
    """
    df.hint("rebalance", day).write.mode("overwrite").partitionBy(day).parquet(path)
