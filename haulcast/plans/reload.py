"""The daily reload: sums kept by day, of which only the changed days are made anew.

The store holds one row per day, entity and equipment: rows, volume and distinct
shipments. Days are folders; a reload reads the rows of the changed days and
overwrites their folders alone. Rankings and base table are sums over the store,
so they never read the shipments of days that stayed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.functions.numbers import quoted
from haulcast.functions.text import short_name
from haulcast.operators import topk
from haulcast.plans import history

STORE = "entity string, equipment_gid string, n_rows bigint, total_volume double, n_shipments bigint, ship_date date"


def daily_sums(rows: DataFrame) -> DataFrame:
    """Rows of a side summed by day, entity and equipment; rows without a shipment id count as one shipment."""
    keys = ["ship_date", "entity", "equipment_gid"]
    # First by shipment too, so that a hot day or customer spreads over all tasks.
    shipments = rows.where(F.col("ship_date").isNotNull()).groupBy(*keys, "shipment_xid")
    shipments = shipments.agg(F.count("*").alias("n_rows"), F.sum("total_volume").alias("total_volume"))
    return shipments.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("total_volume").alias("total_volume"), F.count("*").alias("n_shipments")
    )


def load_all(path: str, rows: DataFrame) -> None:
    """The first load: every day that has rows."""
    _by_day(daily_sums(rows)).write.mode("overwrite").partitionBy("ship_date").parquet(path)


def _by_day(sums: DataFrame) -> DataFrame:
    """A day is few rows and a file of its own: writing is spread by the number of days and not by their bytes."""
    return sums.repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ship_date")


def reload_days(spark: SparkSession, path: str, rows: DataFrame, days: Sequence[date]) -> None:
    """Make the given days of the store anew from ``rows``; a day that has no rows any more becomes empty."""
    changed = rows.where(F.col("ship_date").isin(list(days)))
    # Every changed day gets a row of its own, so that its folder is replaced in any case.
    marks = spark.createDataFrame([(None, None, 0, None, 0, d) for d in days], STORE)
    columns = [c.split()[0] for c in STORE.split(", ")]
    fresh = daily_sums(changed).select(*columns).unionByName(marks)
    writer = _by_day(fresh).write.mode("overwrite").partitionBy("ship_date")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path).where(F.col("n_rows") > 0)


def open_store(sums: DataFrame, side: history.Side) -> tuple[list[str], list[str] | None]:
    """Kept equipment and entities of a side, ranked from the stored sums."""
    profiled = sums.groupBy("entity", "equipment_gid").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("total_volume").alias("total_volume")
    )
    trucks = history.top_trucks(profiled, side.top_trucks)
    kept = topk.top_names(trucks, "equipment_gid")
    if side.top_entities is None:
        return kept, None
    return kept, topk.top_names(history.top_entities(profiled, trucks, side.top_entities), "entity")


def base_table(sums: DataFrame, side: history.Side) -> DataFrame:
    """The side's base table, equal to the one made from all its rows.

    A shipment that uses two kinds of equipment of one short name would count twice, so such a pair is refused.
    """
    gids, entities = open_store(sums, side)
    trucks = sorted({short_name(g) for g in gids})
    if len(trucks) != len(gids):
        raise ValueError(f"kept equipment shares a short name: {gids}")
    rows = sums.where((F.col("equipment_gid").isin(gids) | F.col("equipment_gid").isNull()) & F.col("entity").isNotNull())
    if entities is not None:
        rows = rows.where(F.col("entity").isin(entities))
    of = {short_name(g): g for g in gids}
    counts = [
        F.coalesce(F.sum(F.when(F.col("equipment_gid") == F.lit(of[t]), F.col("n_shipments"))), F.lit(0)).alias(t) for t in trucks
    ]
    wide = rows.groupBy("ship_date", "entity").agg(F.coalesce(F.sum("total_volume"), F.lit(0.0)).alias("total_volume"), *counts)
    return dates.with_calendar(wide).select(*[F.col(quoted(c)) for c in ("ship_date", "entity", *dates.FEATURES, *trucks)])
