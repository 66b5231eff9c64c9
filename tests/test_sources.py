from datetime import date, datetime
from pathlib import Path

import pytest

from haulcast import schemas
from haulcast.sources import files, jdbc, sqltext
from haulcast.staging import new_path, shared_folder, stage_table, staged


def test_headerless_forecast_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "forecast.csv"
    lines = [
        "42,2019/Oct/30,ISLAND,Harbour,12.25,2019-09-02 07:30:00.125,ann,2019-09-03 08:00:00.5,bob",
        "41,2019/Nov/01,INLAND,Hills,80,2019-09-02 07:30:00.125,ann,2019-09-03 08:00:00.5,bob",
    ]
    path.write_bytes("﻿".encode() + "\n".join(lines).encode())
    out = files.read_forecast_csv(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.date_str, r.volume_forecast) for r in out] == [(41, "2019/Nov/01", 80.0), (42, "2019/Oct/30", 12.25)]
    assert out[0].created_at == datetime(2019, 9, 2, 7, 30, 0, 125000)


def test_punctuated_names_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(date(2021, 2, 8), 3, 0)], "ship_date date, `Name (x.y) z - w-10T` bigint, `B-1T` bigint")
    for fmt in ("csv", "parquet"):
        files.write_matrix(df, str(tmp_path / fmt), fmt)
        assert files.read_matrix(spark, str(tmp_path / fmt), df.schema, fmt).collect() == df.collect()


def test_json_keeps_dates_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(date(2021, 2, 8), None, 1.5)], "ship_date date, entity string, total_volume double")
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()


HARD = [
    (1, "  two blanks  ", datetime(2021, 2, 8, 1, 2, 3, 456789), 0.1),
    (2, 'a "quoted", text', datetime(1999, 12, 31, 23, 59, 59, 999999), -1e300),
    (3, "line\nbreak\r\nand \\ slash", None, None),
    (4, "", datetime(2021, 2, 8), 1.5),
    (5, None, None, 0.0),
    (6, "ünïcode, 'single'", datetime(2021, 2, 8, 0, 0, 0, 1), 2.0),
]
HARD_SCHEMA = "n int, s string, t timestamp_ntz, v double"


def test_csv_keeps_every_value(spark, tmp_path):
    df = spark.createDataFrame(HARD, HARD_SCHEMA)
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(HARD)


def test_json_keeps_every_value(spark, tmp_path):
    df = spark.createDataFrame(HARD, HARD_SCHEMA)
    files.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path / "j"), df.schema).collect())) == sorted(HARD)


def test_header_names_decide_over_positions(spark, tmp_path):
    path = tmp_path / "edits.csv"
    path.write_text("entity,volume_text,ship_date\nSOUTH,40,2021-07-01\n")
    out = files.read_csv(spark, str(path), schemas.OVERRIDES).collect()
    assert [tuple(r) for r in out] == [(date(2021, 7, 1), "SOUTH", "40")]
    path.write_text("entity,volume_text\nSOUTH,40\n")
    with pytest.raises(ValueError, match="ship_date"):
        files.read_csv(spark, str(path), schemas.OVERRIDES)


def test_history_is_partitioned_by_day(spark, tmp_path):
    rows = [(date(2021, 2, 8), i) for i in range(50)] + [(date(2021, 2, 9), 1)]
    df = spark.createDataFrame(rows, "ship_date date, n int")
    files.write_history(df, str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 51
    assert (tmp_path / "h" / "ship_date=2021-02-09").is_dir()


def test_connection_options_come_from_the_caller():
    options = jdbc.connection("jdbc:sqlserver://host;databaseName=d", user="u", password="p")
    split = jdbc.partitioning("start_ts", datetime(2021, 1, 1), datetime(2021, 2, 1), 32)
    out = jdbc.table_options("shipments", options, split)
    assert out["driver"] == "com.microsoft.sqlserver.jdbc.SQLServerDriver"
    assert (out["dbtable"], out["numPartitions"], out["lowerBound"]) == ("shipments", "32", "2021-01-01 00:00:00")
    assert jdbc.connection("jdbc:oracle:thin:@host")["driver"] == "oracle.jdbc.OracleDriver"
    assert "password" not in jdbc.connection("jdbc:oracle:thin:@host")
    oracle = jdbc.table_options("t", jdbc.connection("jdbc:oracle:thin:@host"))
    assert (out["preferTimestampNTZ"], oracle["preferTimestampNTZ"]) == ("true", "false")
    window = jdbc.since("s", "start_ts", datetime(2021, 1, 2, 3))
    assert window == "(SELECT * FROM s WHERE start_ts >= TIMESTAMP '2021-01-02 03:00:00') windowed"
    asked = jdbc.query_options("SELECT 1", options)
    assert asked["query"] == "SELECT 1" and "dbtable" not in asked
    with pytest.raises(ValueError):
        jdbc.partitioning("start_ts", datetime(2021, 1, 1), datetime(2021, 1, 1), 2)


def test_times_with_a_zone_lose_it(spark):
    df = spark.sql("SELECT TIMESTAMP '2021-01-02 03:04:05' AS `a.b`, 1 AS n")
    out = jdbc.without_zone(df)
    assert dict(out.dtypes) == {"a.b": "timestamp_ntz", "n": "int"}
    assert out.first()[0] == datetime(2021, 1, 2, 3, 4, 5)


def test_every_stored_sql_text_runs_on_empty_tables(spark):
    shipments = spark.createDataFrame([], schemas.SHIPMENTS)
    locations = spark.createDataFrame([], schemas.LOCATIONS)
    forecast = spark.createDataFrame([], schemas.VOLUME_FORECAST)
    args = {"principal": "P", "perspective": "S", "domain": "D", "as_of": "2021-03-31"}
    recent = sqltext.run(spark, "shipments_recent", args, shipments=shipments, locations=locations)
    assert (recent.count(), len(recent.columns)) == (0, 27)
    args |= {"domain_pattern": "%D%", "location_domain_pattern": "%D%", **{f"segment_{i}": "S" for i in range(1, 5)}}
    training = sqltext.run(spark, "shipments_training", args, shipments=shipments, locations=locations)
    assert (training.count(), len(training.columns)) == (0, 13)
    assert sqltext.run(spark, "location_lookup", shipments=shipments, locations=locations).count() == 0
    assert sqltext.run(spark, "forecast_all", forecast=forecast).columns == schemas.VOLUME_FORECAST.names
    assert sqltext.run(spark, "forecast_current", {"as_of": "2021-03-31"}, forecast=forecast).count() == 0


def test_two_locations_for_one_key_fail_loudly(spark):
    shipments = spark.createDataFrame([("g", 1.0, "L")], "shipment_xid string, total_volume double, dest_location_gid string")
    locations = spark.createDataFrame([("L", "a", "z"), ("L", "b", "z")], "location_gid string, location_name string, zone2 string")
    with pytest.raises(Exception, match="several locations for one key: L"):
        sqltext.run(spark, "location_lookup", shipments=shipments, locations=locations).collect()


def test_staged_files_go_with_the_block(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    with staged(df, "t", partition_by="s") as table:
        assert sorted(tuple(r) for r in table.collect()) == [(1, "a"), (2, "b")]
        written = [f.split(":")[-1] for f in table.inputFiles()]
        assert all(Path(f).exists() for f in written)
    assert not any(Path(f).exists() for f in written)


def test_staging_uses_the_shared_folder(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    staged = stage_table(df, "t")
    assert staged.collect() == df.collect()
    assert all(shared_folder(spark).split(":")[-1] in f for f in staged.inputFiles())
    assert new_path(spark, "t") != new_path(spark, "t")
