"""Volume side: uploaded forecast to edited daily volumes with features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.functions.numbers import edited_number, round_even
from haulcast.operators import filters


def parse(forecast: DataFrame) -> DataFrame:
    """Dates as DATE and upper-case entity names, converted once on the way in."""
    return forecast.select(
        dates.forecast_date(F.col("date_str")).alias("ship_date"),
        "segment",
        F.upper("cust_region").alias("entity"),
        F.col("volume_forecast").alias("total_volume"),
        "date_str",
    )


def rejected_dates(forecast: DataFrame) -> DataFrame:
    """How many rows carry text that is no date."""
    bad = F.col("ship_date").isNull() & F.col("date_str").isNotNull()
    return parse(forecast).agg(F.count_if(bad).alias("n_rejected"), F.count("*").alias("n_rows"))


def load(forecast: DataFrame, as_of: date | None = None) -> DataFrame:
    """Current rows, or all rows when the whole table lies in the past."""
    return filters.current_or_all(parse(forecast), "ship_date", as_of)


def daily(parsed: DataFrame, segments=None) -> DataFrame:
    """Volume per day and entity, two places; the unit that a user edits."""
    rows = parsed if segments is None else filters.in_segments(parsed, segments)
    return (
        rows.where(F.col("ship_date").isNotNull() & F.col("entity").isNotNull())
        .groupBy("ship_date", "entity")
        .agg(round_even(F.coalesce(F.sum("total_volume"), F.lit(0.0)), 2).alias("total_volume"))
    )


def what_if(volumes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Edited cells replace uploaded volumes; text that is no number changes nothing.

    Names follow the rule of uploads: upper case. Overrides are reduced to one
    value per cell first, so a cell edited twice cannot multiply rows: the last
    readable edit by ``edit_no`` where the table has that column, else the largest.
    """
    return volumes.join(_last_edits(overrides), ["ship_date", "entity"], "left").select(
        "ship_date", "entity", F.coalesce("edited", "total_volume").alias("total_volume")
    )


def changed_cells(volumes: DataFrame, overrides: DataFrame) -> DataFrame:
    """The cells of ``volumes`` that the edits give another volume, with that volume."""
    edits = _last_edits(overrides)
    other = ~F.col("edited").eqNullSafe(F.col("total_volume"))
    cells = volumes.join(edits, ["ship_date", "entity"]).where(other)
    return cells.select("ship_date", "entity", F.col("edited").alias("total_volume"))


def _last_edits(overrides: DataFrame) -> DataFrame:
    """One readable edit per cell."""
    return _edits(overrides).groupBy("ship_date", "entity").agg(F.max_by("edited", "edit_no").alias("edited"))


def _edits(overrides: DataFrame) -> DataFrame:
    """Readable edits: (ship_date, entity, edited, edit_no)."""
    value = edited_number(F.col("volume_text"))
    order = F.struct("edit_no", value) if "edit_no" in overrides.columns else F.struct(value)
    rows = overrides.select("ship_date", F.upper("entity").alias("entity"), value.alias("edited"), order.alias("edit_no"))
    return rows.where(F.col("edited").isNotNull())


def unmatched_edits(volumes: DataFrame, overrides: DataFrame) -> DataFrame:
    """How many readable edits name a cell that the table does not have."""
    cells = volumes.select("ship_date", "entity").distinct()
    return _edits(overrides).join(cells, ["ship_date", "entity"], "left_anti").agg(F.count("*").alias("n_unmatched"))


def rejected_edits(overrides: DataFrame) -> DataFrame:
    bad = F.col("volume_text").isNotNull() & edited_number(F.col("volume_text")).isNull()
    return overrides.agg(F.count_if(bad).alias("n_rejected"), F.count("*").alias("n_rows"))


def features(volumes: DataFrame) -> DataFrame:
    """Model input by name: total_volume, year, month, weekday."""
    return dates.with_calendar(volumes).select("ship_date", "entity", *dates.FEATURES)
