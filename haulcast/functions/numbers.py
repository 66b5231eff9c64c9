"""Rounding and safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Digits with an optional sign, decimal point and exponent.
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def quoted(name: str) -> str:
    """Column reference that survives dots, spaces and brackets in ``name``."""
    return "`" + name.replace("`", "``") + "`"


def round_even(value: Column, places: int = 0) -> Column:
    """Half-to-even on the scaled double, as NumPy rounds.

    ``bround`` goes through decimal text and differs on values such as 2.345.
    """
    if places == 0:
        return F.rint(value)
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def whole(value: Column) -> Column:
    """Prediction to a whole number of trucks."""
    return F.rint(value).cast("bigint")


def round_all_doubles(df: DataFrame, places: int = 2) -> DataFrame:
    """Round every double column, chosen from the schema."""
    return df.select(
        [
            round_even(F.col(quoted(f.name)), places).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(quoted(f.name))
            for f in df.schema.fields
        ]
    )


def edited_number(text: Column) -> Column:
    """Text typed into a table cell; NULL when it is not a plain finite decimal number."""
    typed = F.trim(text)
    value = F.when(typed.rlike(PLAIN_NUMBER), typed.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)
