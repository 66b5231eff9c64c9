"""Fixed schemas; nothing in the engine depends on column position."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SHIPMENTS = _schema(
    ("shipment_gid", T.StringType()),
    ("shipment_xid", T.StringType()),
    ("servprov_gid", T.StringType()),
    ("total_ship_unit_count", T.DoubleType()),
    ("total_weight", T.DoubleType()),
    ("total_volume", T.DoubleType()),
    ("equipment_gid", T.StringType()),
    ("equipment_ref_unit_gid", T.StringType()),
    ("icon_gid", T.StringType()),
    ("driver_id", T.StringType()),
    ("vehicle_no", T.StringType()),
    ("total_actual_cost", T.DoubleType()),
    ("loaded_distance", T.DoubleType()),
    ("dest_location_gid", T.StringType()),
    ("source_location_gid", T.StringType()),
    ("principal", T.StringType()),
    ("route", T.StringType()),
    ("transport_mode_gid", T.StringType()),
    ("term_location_text", T.StringType()),
    ("domain_name", T.StringType()),
    ("perspective", T.StringType()),
    ("start_ts", T.TimestampNTZType()),
    ("end_ts", T.TimestampNTZType()),
)

LOCATIONS = _schema(
    ("location_gid", T.StringType()),
    ("location_name", T.StringType()),
    ("province", T.StringType()),
    ("city", T.StringType()),
    ("zone1", T.StringType()),
    ("zone2", T.StringType()),
    ("segment", T.StringType()),
    ("domain_name", T.StringType()),
)

VOLUME_FORECAST = _schema(
    ("id", T.IntegerType()),
    ("date_str", T.StringType()),
    ("segment", T.StringType()),
    ("cust_region", T.StringType()),
    ("volume_forecast", T.DoubleType()),
    ("created_at", T.TimestampNTZType()),
    ("created_by", T.StringType()),
    ("updated_at", T.TimestampNTZType()),
    ("updated_by", T.StringType()),
)

FLEET_LONG = _schema(
    ("ship_date", T.DateType()),
    ("entity", T.StringType()),
    ("truck", T.StringType()),
    ("forecast", T.LongType()),
)

OVERRIDES = _schema(
    ("ship_date", T.DateType()),
    ("entity", T.StringType()),
    ("volume_text", T.StringType()),
)
