"""Long to wide, wide to long, and the transposed display form."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.functions.numbers import edited_number, quoted, round_even
from haulcast.functions.text import fleet_column


def volume_pivot(volumes: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Day by entity, volumes summed, rounded to 2 places, gaps 0."""
    wide = volumes.groupBy("ship_date").pivot("entity", list(entities)).agg(F.sum("total_volume"))
    return wide.select(
        "ship_date", *[F.coalesce(round_even(F.col(quoted(e)), 2), F.lit(0.0)).alias(e) for e in entities]
    )


def volume_unpivot(wide: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Day by entity back to one row per cell."""
    return wide.unpivot("ship_date", [F.col(quoted(e)) for e in entities], "entity", "total_volume")


def volume_grid(volumes: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """Every day with every entity (of ``entities``, or of the table), cells without volume being 0.

    This is the table a user edits: an empty cell can be filled, and is scored
    as a day of no volume. The listed names are spread over the days in long
    form, so the plan does not widen with them. ``volumes`` has one row per cell.
    """
    if entities is None:
        names = volumes.agg(F.sort_array(F.collect_set("entity"))).scalar()
    else:
        names = F.array([F.lit(e) for e in entities]).cast("array<string>")
    cells = volumes.select("ship_date").distinct().select("ship_date", F.explode(names).alias("entity"))
    known = volumes.select("ship_date", "entity", "total_volume")
    return cells.join(known, ["ship_date", "entity"], "left").withColumn(
        "total_volume", F.coalesce(round_even(F.col("total_volume"), 2), F.lit(0.0))
    )


def transpose_days(wide: DataFrame, entities: Sequence[str], days: Sequence[date]) -> DataFrame:
    """One row per entity, one labelled column per day of the horizon.

    The caller's day list fixes the schema; the cells meet in one aggregate.
    """
    cells = volume_unpivot(wide, entities)
    columns = [
        F.coalesce(F.sum(F.when(F.col("ship_date") == F.lit(d), F.col("total_volume"))), F.lit(0.0)).alias(
            dates.label_of(d)
        )
        for d in days
    ]
    return cells.groupBy("entity").agg(*columns)


def days_left_out(wide: DataFrame, days: Sequence[date]) -> DataFrame:
    """Days of ``wide`` that a horizon of ``days`` does not show."""
    return wide.where(F.col("ship_date").isNull() | ~F.col("ship_date").isin(list(days))).select("ship_date").distinct()


def days_to_rows(transposed: DataFrame, day_labels: Sequence[str]) -> DataFrame:
    """Inverse: labelled day columns straight to (ship_date, entity, total_volume)."""
    texts = transposed.select("entity", *[F.col(quoted(d)).cast("string").alias(d) for d in day_labels])
    cells = texts.unpivot("entity", [F.col(quoted(d)) for d in day_labels], "day_label", "volume_text")
    return cells.select(
        dates.label_to_date(F.col("day_label")).alias("ship_date"),
        "entity",
        edited_number(F.col("volume_text")).alias("total_volume"),
    )


def spine_join(days: DataFrame, fleet: DataFrame) -> DataFrame:
    """Every day of the input, with its forecasts where there are any."""
    return days.select("ship_date").distinct().join(fleet, "ship_date", "left")


def fleet_matrix(fleet: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per day, one column per ``entity-truck`` name, gaps 0.

    Entities without forecasts keep their zero columns, so the schema is the
    caller's list and not an accident of the data.
    """
    named = fleet.withColumn("fleet", fleet_column(F.col("entity"), F.col("truck")))
    wide = named.groupBy("ship_date").pivot("fleet", list(names)).agg(F.max("forecast"))
    return wide.na.fill(0)


def dedup_matrix(matrix: DataFrame) -> DataFrame:
    """Drop repeated rows, the day being part of the row."""
    return matrix.dropDuplicates()


def error_widths(df: DataFrame, y: str, upper: str, lower: str) -> DataFrame:
    """Asymmetric error-bar widths around ``y``."""
    mid, top, low = F.col(quoted(y)), F.col(quoted(upper)), F.col(quoted(lower))
    return df.withColumns({"error_up": top - mid, "error_down": mid - low})
