"""From raw documents to sharded training data, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's input. All stages but the last
return the columns of ``documents``. Further columns of the caller pass through
every stage unchanged, whatever their names: a stage works beside them.

Defined cases, for every stage: a null text is an empty one; a null id or source
is a value like any other; rows that repeat are rows of their own; texts of any
length are read whole; an empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.llm import decontaminate as leaks
from haulcast.llm import mixing, neardup, quality, sharding
from haulcast.llm.tables import col, documents, small_batches, table
from haulcast.session import tune
from haulcast.staging import stage_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Columns that stages read.
READ = ("doc_id", "text", "source")


def _beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on ``docs``, whose other columns bear names of no stage meanwhile."""
    names = {c: c if c in READ else f"__caller_{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*[col(docs, c).alias(name) for c, name in names.items()]))
    return out.select(*[F.col(name).alias(c) for c, name in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail a rule, or whose host is refused.

    An empty text has too few words and goes. Documents without a source share one host.
    """
    return _beside(docs, lambda d: quality.judge(quality.measure(d)).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group of near-duplicates (five words, 0.8).

    Empty texts and rows without an id are linked with nothing and stay; rows
    repeating an id stay or go together.
    """
    small_batches(spark)
    found = neardup.near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    found = stage_table(found, "copies").withColumnRenamed("doc_id", "__copy")
    return docs.join(found, col(docs, "doc_id") == F.col("__copy"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, word for word or in other words; empty texts hold none."""
    small_batches(spark)
    return _beside(docs, lambda d: leaks.drop_leaks(d, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that every source has an equal share; null is a source of its own. Rows of one id are repeated alike."""
    return _beside(docs, mixing.mix_sources)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place documents in eight shards by their id: equal ids, and all null ones, share a shard.

    Adds ``shard``, ``slot`` and ``grown_shard``, which replace columns of these names.
    """
    return sharding.shard_records(docs, spread_by=["n_chars"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
    ("shard", shard),
]

#: The search for leaked passages is no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
