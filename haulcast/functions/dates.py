"""Dates, calendar features and labels."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The text formats of the forecast table and of the screen labels.
FORECAST_DATE = "yyyy/MMM/dd"
LABEL_WITH_YEAR = "MMM dd yyyy"
LABEL_SHORT = "MMM dd"

FEATURES = ("total_volume", "year", "month", "weekday")


def as_of_date(as_of: date | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def as_of_timestamp(as_of: datetime | date | Column | None) -> Column:
    """Reference moment without a time zone, like the stored start times."""
    if as_of is None:
        return F.localtimestamp()
    return (as_of if isinstance(as_of, Column) else F.lit(str(as_of))).cast("timestamp_ntz")


def months_before(moment: Column, months: int) -> Column:
    """Month arithmetic that keeps the time of day and clips at month end."""
    return F.timestamp_add("MONTH", F.lit(-months), moment)


def forecast_date(text: Column) -> Column:
    """``2021/Feb/09`` to a date; NULL for text that is no date."""
    return F.try_to_date(text, FORECAST_DATE)


def label(day: Column, pattern: str = LABEL_WITH_YEAR) -> Column:
    return F.date_format(day, pattern)


def label_to_date(text: Column, pattern: str = LABEL_WITH_YEAR) -> Column:
    return F.to_date(text, pattern)


def label_of(day: date) -> str:
    """The label of one driver-side date, equal to ``label`` on a column."""
    months = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
    return f"{months[day.month - 1]} {day.day:02d} {day.year}"


def with_calendar(df: DataFrame, day: str = "ship_date") -> DataFrame:
    """Year, month and weekday (Monday 1 to Sunday 7)."""
    return df.withColumns(
        {
            "year": F.year(day),
            "month": F.month(day),
            "weekday": F.weekday(day) + F.lit(1),
        }
    )
