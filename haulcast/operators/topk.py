"""Rankings and pruning to the top k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions.numbers import quoted


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL not counted."""
    key = F.col(quoted(column))
    return df.where(key.isNotNull()).groupBy(key.alias(column)).agg(F.count("*").alias("n_rows"))


def top_k(ranked: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """The ``k`` keys of largest measure; ties go to the smaller key."""
    return ranked.orderBy(F.desc(quoted(measure)), F.asc(quoted(key))).limit(k)


def keep_top(df: DataFrame, key: str, top: DataFrame) -> DataFrame:
    """Rows whose key is in ``top``, and rows without a key.

    A frequency table never lists NULL, so a row without a key is never among
    the removed ones. ``top`` comes from ``limit(k)``: its size bound is k rows.
    """
    marked = top.select(F.col(quoted(key)), F.lit(True).alias("__hit"))
    return (
        df.join(F.broadcast(marked), key, "left")
        .where(F.col("__hit") | F.col(quoted(key)).isNull())
        .select([F.col(quoted(c)) for c in df.columns])
    )


def drop_top(df: DataFrame, key: str, top: DataFrame) -> DataFrame:
    """Complement of ``keep_top``: rows whose key is set and not in ``top``."""
    marked = top.select(F.col(quoted(key)))
    return df.where(F.col(quoted(key)).isNotNull()).join(F.broadcast(marked), key, "left_anti").select(
        [F.col(quoted(c)) for c in df.columns]
    )


def top_names(top: DataFrame, key: str) -> list[str]:
    """The k names on the driver; ``top`` holds k rows by construction."""
    return sorted(row[0] for row in top.select(quoted(key)).collect())


def last_rows(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Last ``n`` rows in key order, by a distributed top-n."""
    return df.orderBy([F.desc(quoted(k)) for k in keys]).limit(n)


def first_rows(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    return df.orderBy([F.asc(quoted(k)) for k in keys]).limit(n)
