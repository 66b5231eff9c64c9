"""Shipments with their locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Location columns by the name they get in the destination role.
DESTINATION = {
    "location_name": "dest_name",
    "province": "region",
    "city": "city",
    "zone1": "dest_zone1",
    "zone2": "dest_zone2",
    "segment": "segment",
}


def destinations(locations: DataFrame) -> DataFrame:
    """Location table in the destination role."""
    return locations.select(
        F.col("location_gid").alias("dest_location_gid"),
        F.col("domain_name").alias("dest_domain_name"),
        *[F.col(name).alias(role) for name, role in DESTINATION.items()],
    )


def sources(locations: DataFrame) -> DataFrame:
    """Location table in the source role."""
    return locations.select(
        F.col("location_gid").alias("source_location_gid"), F.col("location_name").alias("source_name")
    )


def with_destination(shipments: DataFrame, locations: DataFrame, how: str = "inner") -> DataFrame:
    """One join brings all destination attributes."""
    return shipments.join(destinations(locations), "dest_location_gid", how)


def with_source(shipments: DataFrame, locations: DataFrame, how: str = "left") -> DataFrame:
    """The same dimension again, keyed on the source."""
    return shipments.join(sources(locations), "source_location_gid", how)
