"""Session settings the plans are written for."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike.
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot location or order may hold a third of the fact: let AQE cut its
    # partition into several tasks on either side of a sort-merge join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where an aggregate reuses the join's partitioning: a split hot key is worth a shuffle more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Where every partition of one side is small, hash it instead of sorting both.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.ui.enabled": "false",
}

#: Settings of COMMON that a running session may still take.
RUNTIME = [key for key in COMMON if key.startswith("spark.sql.adaptive.")]

#: On a cluster. 100 TB in 1 GB splits are 100,000 map tasks, of which the plans read
#: a few columns each. Some 10 TB then cross the one wide shuffle: 10,000 reducers keep
#: each near 1 GB and the map-by-reduce blocks near 10 KB. AQE merges what turns out small.
CLUSTER = {
    "spark.sql.files.maxPartitionBytes": "1g",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "10000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
}


def build_session(
    app: str = "haulcast", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    """Session for ``master``; without one, whatever ``spark-submit`` chose."""
    builder = SparkSession.builder.appName(app)
    settings = dict(COMMON)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            settings["spark.sql.shuffle.partitions"] = "8"
            settings["spark.driver.bindAddress"] = "127.0.0.1"
            settings["spark.driver.host"] = "127.0.0.1"
    elif not SparkConf().get("spark.master", "local").startswith("local"):
        settings.update(CLUSTER)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Give a session that was built elsewhere the skew settings it leaves open."""
    for key in RUNTIME:
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, COMMON[key])
    return spark
