"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

#: Spark type name to the DuckDB types that hold the same values.
SAME = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "date": {"DATE"},
    "timestamp_ntz": {"TIMESTAMP"},
    "timestamp": {"TIMESTAMP"},
    "boolean": {"BOOLEAN"},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs between the Spark frame and the SQL, empty when equal."""
    result = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in result.description}
    duck_names, duck_rows = _sorted_rows([d[0] for d in result.description], result.fetchall())
    spark_names, spark_rows = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if duck_names != spark_names:
        return [f"columns {spark_names} != {duck_names}"]
    for name, dtype in df.dtypes:
        if duck_types[name] not in SAME[dtype]:
            out.append(f"type of {name}: {dtype} vs {duck_types[name]}")
    if len(duck_rows) != len(spark_rows):
        out.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    wrong = [(s, d) for s, d in zip(spark_rows, duck_rows) if s != d]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return out
