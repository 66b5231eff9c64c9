"""The physical plans: what is pushed, shuffled, broadcast, and what must not appear."""

from __future__ import annotations

import re
from contextlib import contextmanager
from datetime import date

import oracle
import pytest
from pyspark.sql import functions as F

from haulcast.catalog import oracles, queries
from haulcast.operators import filters, joins
from haulcast.session import tune
from haulcast.sources import files, standin

ALL = queries.all_queries()
FITTED = {n for n in ALL if n.startswith(("fit_", "train_", "accuracy_", "fleet_"))} - {"fleet_wide", "fleet_rule_matrix"} | {"model_store"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    return plan(df).split("== Initial Plan ==")[0]


@contextmanager
def settings(spark, **values):
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(set(ALL) - FITTED))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(ALL[name](spark, sf_dir))
    for node in ("PythonUDF", "EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_base_table_has_one_wide_shuffle_and_no_expand(spark, sf_dir):
    text = plan(queries.abt_customer(spark, sf_dir))
    assert "Expand" not in text
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 2
    assert any("shipment_xid" in e for e in exchanges)  # the wide one spreads a hot day or customer


def test_scan_reads_only_what_the_base_table_needs(spark, sf_dir):
    text = plan(queries.abt_region(spark, sf_dir))
    lines = next(l for l in text.splitlines() if "FileScan" in l and "lineitem" in l)
    read = re.search(r"ReadSchema: struct<([^>]*)>", lines).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"l_orderkey", "l_partkey", "l_quantity", "l_shipdate"}


def test_segment_filter_reaches_the_reader(spark, sf_dir):
    text = plan(queries.abt_region(spark, sf_dir))
    customer = next(l for l in text.splitlines() if "FileScan" in l and "customer" in l)
    assert "In(c_mktsegment, [AUTOMOBILE,HOUSEHOLD])" in customer


def test_time_window_reaches_the_reader(spark, sf_dir):
    rows = standin.table(spark, sf_dir, "lineitem")
    text = plan(filters.trailing_months(rows, "l_shipdate", 25, date(2001, 6, 1)))
    assert "GreaterThanOrEqual(l_shipdate,1999-05-01T00:00)" in text
    assert "LessThanOrEqual(l_shipdate,2001-06-01T00:00)" in text


def test_lookup_without_broadcasts_is_a_hashed_join(spark, sf_dir):
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, **off):
        text = plan(ALL["scalar_subquery_lookup"](spark, sf_dir))
    assert "NestedLoop" not in text and "Cartesian" not in text and "SortMergeJoin" in text


def test_time_window_prunes_day_folders(spark, tmp_path):
    rows = spark.range(90).select(
        F.col("id"), F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2021-01-01").cast("timestamp_ntz")).alias("start_ts")
    )
    files.write_history(rows.withColumn("ship_date", F.to_date("start_ts")), str(tmp_path / "h"))
    kept = filters.trailing_months(spark.read.parquet(str(tmp_path / "h")), "start_ts", 1, date(2021, 3, 20))
    assert re.search(r"PartitionFilters: \[[^\]]*ship_date[^\]]*>= 2021-02-20", plan(kept))
    assert kept.count() == rows.where("start_ts >= '2021-02-20' and start_ts <= '2021-03-20'").count()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("hash_limit", "join"), [("0", "SortMergeJoin"), ("64m", "ShuffledHashJoin")])
@pytest.mark.parametrize("grouping", ["segment", "dest_location_gid"])
def test_hot_destination_is_split(spark, how, hash_limit, join, grouping):
    """A third of all shipments goes to one place: AQE cuts its partition into tasks, sorted or hashed.

    Grouping by the join key would reuse its partitioning; the cut has precedence.
    """
    n = 300_000
    key = F.when(F.col("id") < n // 3, F.lit("L0")).otherwise(F.concat(F.lit("L"), F.col("id") % 997))
    facts = spark.range(0, n, 1, 8).select(
        F.col("id").alias("shipment_xid"), key.alias("dest_location_gid"), F.rpad(F.lit(""), 40, "x").alias("pad")
    )
    places = spark.range(997).select(
        F.concat(F.lit("L"), F.col("id")).alias("location_gid"),
        *[F.lit("n").alias(c) for c in ("location_name", "province", "city", "zone1", "zone2", "segment", "domain_name")],
    )
    with settings(
        spark,
        **{
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": hash_limit,
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        },
    ):
        counted = joins.with_destination(facts, places, how).groupBy(grouping).agg(
            F.count("*").alias("n"), F.sum("shipment_xid").alias("ids")
        )
        rows = counted.collect()
        assert (sum(r.n for r in rows), sum(r.ids for r in rows)) == (n, n * (n - 1) // 2)
        text = final_plan(counted)
        assert f"{join}(skew=true)" in text
        assert "AQEShuffleRead coalesced and skewed" in text


@pytest.mark.parametrize("name", ["abt_customer", "abt_region", "join_two_roles", "vol_pivot_region", "what_if_volumes"])
def test_results_do_not_depend_on_broadcasts(spark, sf_dir, name):
    """Dimensions beyond the bound: the same rows through shuffles."""
    with settings(
        spark,
        **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"},
    ):
        df = ALL[name](spark, sf_dir)
        assert oracle.differences(df, oracle.connect(sf_dir), oracles.all_oracles()[name]) == []
        assert "BroadcastHashJoin" not in final_plan(df)


def test_open_settings_are_filled_and_given_ones_kept(spark):
    key, other = "spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    with settings(spark, **{key: "false", other: "1m"}):
        spark.conf.unset(other)
        tune(spark)
        assert spark.conf.get(key) == "false"
        assert spark.conf.get(other) == "64m"


def test_orders_get_their_destination_before_the_lines(spark, tmp_path):
    """The same rows as joining line by line, repeated and null keys included, with one shuffle of the lines less."""
    from haulcast.catalog.queries import join_two_roles
    from haulcast.operators import joins
    from haulcast.sources import standin

    rows = {
        "region": [(0, "EAST")], "nation": [(0, "N0", 0), (1, "N1", 0)], "part": [(1, "p", "b", "t", 1, 1.0)],
        "customer": [(1, "c1", 0, 0.0, "S"), (1, "c1 again", 1, 0.0, "S"), (2, "c2", 1, 0.0, "S")],
        "supplier": [(7, "s7", 1, 0.0)],
        "orders": [(1, 1, "O", 1.0, None, "x"), (2, None, "O", 1.0, None, "x"), (3, 9, "O", 1.0, None, "x"), (4, 2, "O", 1.0, None, "x"), (4, 2, "O", 2.0, None, "y")],
        "lineitem": [(o, 1, s, n, float(n), 1.0, 0.0, 0.0, "N", "O", None) for n, (o, s) in enumerate([(1, 7), (1, None), (2, 7), (3, 8), (4, 7), (4, 7), (None, 7)])],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, standin.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = f"file://{tmp_path}"
    got = join_two_roles(spark, sf)
    locations = standin.locations(spark, sf)
    by_line = joins.with_source(joins.with_destination(standin.shipments(spark, sf), locations, "left"), locations)
    want = by_line.select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (l_orderkey") < plan.index("Join LeftOuter, (dest_location_gid")
