"""Input tables and small frame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def col(df: DataFrame, name: str) -> Column:
    """A column by its plain name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns under names of the operator's own, so that no further column can clash."""
    return df.select(*[col(df, old).alias(new) for new, old in wanted.items()])


#: Rows of an Arrow batch between Spark and Python: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Let the session send at most BATCH_ROWS rows to Python at once; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "0") or 0)
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def spread(df: DataFrame) -> int:
    """Shuffle partitions of the session: a first figure for how far to deal rows out."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
