"""Database tables through Spark's JDBC reader.

Address, account and driver always come from the caller. Filters on the frame
and the columns used are pushed into the database by the reader.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulcast.functions.numbers import quoted

# Driver class per database, as published by the vendors.
DRIVERS = {
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
}


def connection(url: str, user: str | None = None, password: str | None = None, **extra: str) -> dict[str, str]:
    """Reader options for ``url``; the driver follows from its prefix."""
    options = {"url": url, **extra}
    kind = url.split(":")[1] if url.startswith("jdbc:") else ""
    if kind in DRIVERS:
        options.setdefault("driver", DRIVERS[kind])
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options


def partitioning(column: str, lower: datetime, upper: datetime, tasks: int) -> dict[str, str]:
    """Split a scan into ``tasks`` time slices; rows outside the bounds are still read."""
    if upper <= lower:
        raise ValueError("upper bound must lie after the lower bound")
    return {
        "partitionColumn": column,
        "lowerBound": lower.strftime("%Y-%m-%d %H:%M:%S"),
        "upperBound": upper.strftime("%Y-%m-%d %H:%M:%S"),
        "numPartitions": str(tasks),
    }


def table_options(
    table: str, options: dict[str, str], split: dict[str, str] | None = None, fetch_rows: int = 10_000
) -> dict[str, str]:
    plain = "false" if is_oracle(options) else "true"
    return {**options, **(split or {}), "dbtable": table, "fetchsize": str(fetch_rows), "preferTimestampNTZ": plain}


def since(table: str, column: str, lower: datetime) -> str:
    """``table`` cut by the database itself, as a subquery with a standard timestamp literal.

    Spark leaves a zone-less timestamp unquoted when it pushes a filter to Oracle,
    so the window goes along as text instead.
    """
    return f"(SELECT * FROM {table} WHERE {column} >= TIMESTAMP '{lower:%Y-%m-%d %H:%M:%S}') windowed"


def is_oracle(options: dict[str, str]) -> bool:
    return options.get("url", "").startswith("jdbc:oracle:")


def without_zone(df: DataFrame) -> DataFrame:
    """Time stamps of a reader that gave them a zone, as the plans expect them."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(quoted(name)).cast("timestamp_ntz") for name in zoned}) if zoned else df


def read_table(
    spark: SparkSession, table: str, options: dict[str, str], split: dict[str, str] | None = None
) -> DataFrame:
    return without_zone(spark.read.format("jdbc").options(**table_options(table, options, split)).load())


def query_options(sql: str, options: dict[str, str]) -> dict[str, str]:
    return {**options, "query": sql, "preferTimestampNTZ": "true"}


def read_query(spark: SparkSession, sql: str, options: dict[str, str]) -> DataFrame:
    """Result of a query that the database runs; one task reads it, so keep it to small results."""
    return spark.read.format("jdbc").options(**query_options(sql, options)).load()
