"""Analytics base table: daily volume, calendar and shipments per truck type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.functions.numbers import quoted


def daily_volume(rows: DataFrame) -> DataFrame:
    """Volume per day and entity; a group of NULL volumes totals 0."""
    return _keyed(rows).groupBy("ship_date", "entity").agg(
        F.coalesce(F.sum("total_volume"), F.lit(0.0)).alias("total_volume")
    )


def truck_counts(rows: DataFrame) -> DataFrame:
    """Distinct shipments per day, entity and truck type; rows without an id count as one shipment, as in the base table.

    The shuffle that removes duplicates is hashed on the shipment as well, so a
    hot day or customer spreads over all tasks; what follows is pre-aggregated.
    """
    shipments = _keyed(rows).where(F.col("truck").isNotNull()).select("ship_date", "entity", "truck", "shipment_xid").distinct()
    return shipments.groupBy("ship_date", "entity", "truck").agg(F.count("*").alias("n_shipments"))


def base_table(rows: DataFrame, trucks: list[str]) -> DataFrame:
    """Wide table with one count column per truck in ``trucks``.

    Volume and all counts come from one pass: first one row per shipment, then
    one per (day, entity). Rows without a truck add volume and no count.
    """
    names = ["ship_date", "entity", *dates.FEATURES, *trucks]
    if len({n.lower() for n in names}) != len(names):
        raise ValueError(f"column names must differ: {names}")
    shipments = (
        _keyed(rows)
        .groupBy("ship_date", "entity", "truck", "shipment_xid")
        .agg(F.sum("total_volume").alias("volume"))
    )
    counts = [F.count(F.when(F.col("truck") == F.lit(t), F.lit(1))).alias(t) for t in trucks]
    wide = shipments.groupBy("ship_date", "entity").agg(
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"), *counts
    )
    return dates.with_calendar(wide).select([F.col(quoted(n)) for n in names])


def long_counts(wide: DataFrame, trucks: list[str]) -> DataFrame:
    """Base table with one row per truck, zero counts included."""
    keys = [F.col(n) for n in ("ship_date", "entity", *dates.FEATURES)]
    return wide.unpivot(keys, [F.col(quoted(t)) for t in trucks], "truck", "n_shipments")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("ship_date").isNotNull() & F.col("entity").isNotNull())
