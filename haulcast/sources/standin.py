"""Shipment, location and forecast tables over the star-schema test data.

The test tables play the parts of the operational ones, see FIXTURES.md. Every
frame keeps all rows of its tables; unused columns are pruned by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.functions import dates

# The six truck types and the entity names of the test data, in column order.
TRUCKS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = [f"NATION_{i}" for i in range(25)]
SYNONYMS = {"NATION_1": "NATION_0"}
CUSTOMERS = [n for n in NATIONS if n not in SYNONYMS]
CUSTOMER_SEGMENTS = ["BUILDING", "MACHINERY"]
REGION_SEGMENTS = ["AUTOMOBILE", "HOUSEHOLD"]


# Columns of the test tables: with a schema given, opening a table runs no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
ORDER_COLUMNS = [c.split()[0] for c in SCHEMAS["orders"].split(", ")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _gid(prefix: str, column: str):
    return F.concat(F.lit(prefix + "."), F.col(column).cast("string"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )


def _located(spark: SparkSession, sf_dir: str, base: DataFrame, nation_key: str) -> DataFrame:
    places = _places(spark, sf_dir)
    return base.join(places, F.col(nation_key) == F.col("n_nationkey"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as destinations and suppliers as sources, one key space."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")

    def shaped(base: DataFrame, prefix: str, key: str, nation_key: str, city: str, segment) -> DataFrame:
        return _located(spark, sf_dir, base, nation_key).select(
            _gid(prefix, key).alias("location_gid"),
            F.col("n_name").alias("location_name"),
            F.col("r_name").alias("province"),
            F.col(city).alias("city"),
            F.col("n_name").alias("zone1"),
            F.col("r_name").alias("zone2"),
            segment.alias("segment"),
            F.lit(f"BASE/{prefix}").alias("domain_name"),
        )

    both = shaped(customer, "CUST", "c_custkey", "c_nationkey", "c_name", F.col("c_mktsegment")).unionByName(
        shaped(supplier, "SUPP", "s_suppkey", "s_nationkey", "s_name", F.lit(None).cast("string"))
    )
    return both


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with the destination that all their lines share."""
    return table(spark, sf_dir, "orders").withColumn("dest_location_gid", _gid("CUST", "o_custkey"))


def shipments(spark: SparkSession, sf_dir: str, heads: DataFrame | None = None) -> DataFrame:
    """One shipment row per order line, in the canonical columns.

    ``heads`` are ``order_heads`` with attributes that a join gave them, which every shipment of the order gets.
    """
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders") if heads is None else heads
    dest = _gid("CUST", "o_custkey") if heads is None else F.col("dest_location_gid")
    given = [] if heads is None else [c for c in heads.columns if c != "dest_location_gid" and c not in ORDER_COLUMNS]
    lines = table(spark, sf_dir, "lineitem")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            _gid("DOM", "l_orderkey").alias("shipment_gid"),
            F.col("l_orderkey").alias("shipment_xid"),
            _gid("CARRIER", "l_suppkey").alias("servprov_gid"),
            F.col("l_linenumber").cast("double").alias("total_ship_unit_count"),
            F.col("l_extendedprice").alias("total_weight"),
            F.col("l_quantity").alias("total_volume"),
            _gid("DOM", "p_type").alias("equipment_gid"),
            F.col("p_name").alias("equipment_ref_unit_gid"),
            F.col("p_brand").alias("icon_gid"),
            _gid("DRIVER", "l_linenumber").alias("driver_id"),
            _gid("VEHICLE", "l_partkey").alias("vehicle_no"),
            (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("total_actual_cost"),
            F.col("l_tax").alias("loaded_distance"),
            dest.alias("dest_location_gid"),
            _gid("SUPP", "l_suppkey").alias("source_location_gid"),
            F.col("l_returnflag").alias("principal"),
            F.col("o_orderpriority").alias("route"),
            _gid("MODE", "o_orderstatus").alias("transport_mode_gid"),
            F.col("p_name").alias("term_location_text"),
            F.col("p_brand").alias("domain_name"),
            F.col("l_linestatus").alias("perspective"),
            F.col("l_shipdate").alias("start_ts"),
            (F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("end_ts"),
            *given,
        )
    )


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments with their destination.

    Orders meet customers before the lines do: a segment filter then thins the
    order side ahead of the largest shuffle.
    """
    customer = table(spark, sf_dir, "customer")
    dest = _located(spark, sf_dir, customer, "c_nationkey").select("c_custkey", "c_mktsegment", "n_name", "r_name")
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    placed = orders.join(dest, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "c_mktsegment", "n_name", "r_name"
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("shipment_xid"),
            F.col("l_shipdate").alias("start_ts"),
            F.to_date("l_shipdate").alias("ship_date"),
            F.col("l_quantity").alias("total_volume"),
            F.col("l_extendedprice").alias("total_weight"),
            _gid("DOM", "p_type").alias("equipment_gid"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("dest_name"),
            F.col("r_name").alias("dest_zone2"),
        )
    )


def volume_forecast(spark: SparkSession, sf_dir: str, entity: str = "r_name") -> DataFrame:
    """Uploaded forecast rows: text dates, lower-case region or customer names."""
    customer = table(spark, sf_dir, "customer")
    dest = _located(spark, sf_dir, customer, "c_nationkey")
    return (
        table(spark, sf_dir, "orders")
        .join(dest, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            F.date_format("o_orderdate", dates.FORECAST_DATE).alias("date_str"),
            F.col("c_mktsegment").alias("segment"),
            F.lower(entity).alias("cust_region"),
            F.col("o_totalprice").alias("volume_forecast"),
        )
    )
