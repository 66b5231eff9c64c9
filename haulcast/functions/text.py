"""Names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truck_short_name(gid: Column) -> Column:
    """Text after the first dot; the whole text where there is none."""
    return F.substr(gid, F.locate(".", gid) + F.lit(1))


def short_name(gid: str) -> str:
    """The same rule for one name on the driver."""
    return gid[gid.find(".") + 1 :]


def fleet_column(entity: Column, truck: Column) -> Column:
    """``entity-truck``, the column name in the wide matrix."""
    return F.concat_ws("-", entity, truck)


def fleet_column_names(entities: list[str], trucks: list[str]) -> list[str]:
    return [f"{entity}-{truck}" for entity in entities for truck in trucks]
