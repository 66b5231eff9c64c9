"""Train, store and forecast end to end from canonical tables on disk."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from haulcast import __main__ as cli
from haulcast import schemas
from haulcast.models.candidates import Settings
from haulcast.models.training import Trained
from haulcast.operators import filters, metrics
from haulcast.plans import batch, history
from haulcast.staging import staged

AS_OF = date(2021, 6, 30)
SIDE = history.Side("region", "dest_zone2", ("LOCAL-A", "LOCAL-B"), 2)
TINY = Settings(trees=3, depth=3, boost_rounds=2, gbt_rounds=2)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    names = schemas.SHIPMENTS.names
    rows = []
    for i in range(1200):
        start = datetime(2021, 6, 30, 8) - timedelta(days=i // 10)
        row = dict.fromkeys(names)
        row |= {
            "shipment_gid": f"G{i}",
            "shipment_xid": f"X{i}",
            "total_volume": float(5 + i % 17),
            "equipment_gid": f"D.{['10T', '10T', '10T', '20T', '20T', '1T'][i % 6]}",
            "dest_location_gid": f"L{i % 4}",
            "start_ts": start,
        }
        rows.append(tuple(row[n] for n in names))
    spark.createDataFrame(rows, schemas.SHIPMENTS).write.parquet(f"{folder}/shipments")
    places = [(f"L{i}", f"N{i}", "P", "C", "Z1", ["SOUTH", "NORTH"][i % 2], ["LOCAL-A", "LOCAL-B", "CHAIN", "LOCAL-A"][i], "D") for i in range(4)]
    spark.createDataFrame(places, schemas.LOCATIONS).write.parquet(f"{folder}/locations")
    uploaded = [(1, "2021/Jul/01", "LOCAL", "south", 20.0), (2, "2021/Jul/01", "LOCAL", "north", 30.0), (3, "2021/Jul/02", "LOCAL", "moon", 5.0)]
    spark.createDataFrame(
        [(*u, None, None, None, None) for u in uploaded], schemas.VOLUME_FORECAST
    ).write.parquet(f"{folder}/forecast")
    return str(folder)


def read(spark, tables, name):
    return spark.read.parquet(f"{tables}/{name}")


@pytest.fixture(scope="module")
def trained(spark, tables):
    return batch.train(
        read(spark, tables, "shipments"), read(spark, tables, "locations"), SIDE, AS_OF, TINY, ("random_forest", "adaboost")
    )


def test_pruning_reaches_the_shipment_scan(spark, tables):
    resolved = batch.resolve(read(spark, tables, "shipments"), read(spark, tables, "locations"), 25, AS_OF, True)
    opened = history.open_side(resolved, SIDE)
    assert opened.kept_trucks == ["D.10T", "D.20T"]
    text = opened.base_table()._jdf.queryExecution().executedPlan().toString()
    scan = next(l for l in text.splitlines() if "FileScan" in l and "/shipments" in l)
    assert "Or(In(equipment_gid, [D.10T,D.20T]),IsNull(equipment_gid))" in scan
    assert "GreaterThanOrEqual(start_ts,2019-05-30T00:00)" in scan


def test_an_edit_scores_the_edited_cells_only(spark, tables, trained, monkeypatch):
    shown = batch.from_volumes(read(spark, tables, "forecast"), ["LOCAL"], trained, AS_OF)
    edits = spark.createDataFrame(
        [(date(2021, 7, 1), "South", "400"), (date(2021, 7, 2), "NORTH", "0"), (date(2021, 7, 1), "NORTH", "many"),
         (date(2021, 7, 1), "NORTH", "30"), (date(2030, 1, 1), "SOUTH", "1")],
        schemas.OVERRIDES,
    )
    whole = batch.from_volumes(read(spark, tables, "forecast"), ["LOCAL"], trained, AS_OF, edits)
    scored = []
    plainly = Trained.score
    monkeypatch.setattr(Trained, "score", lambda self, cells: scored.append(cells) or plainly(self, cells))
    edited = batch.edit(shown, edits, trained)
    # One cell gets the volume it had (0 and 30 stay as they are): only the other one is scored.
    assert [(r.ship_date, r.entity) for c in scored for r in c.collect()] == [(date(2021, 7, 1), "SOUTH")]
    for part in ("volumes", "fleet", "matrix", "table", "missing"):
        left, right = getattr(edited, part), getattr(whole, part)
        assert sorted(map(repr, left.select(*right.columns).collect())) == sorted(map(repr, right.collect()))
    assert {tuple(r) for r in edited.rejected.collect()} >= {("unreadable edit", 1), ("edit without a cell", 1)}


def test_volume_run(spark, tables, trained):
    edits = spark.createDataFrame([(date(2021, 7, 1), "SOUTH", "40")], schemas.OVERRIDES)
    out = batch.from_volumes(read(spark, tables, "forecast"), ["LOCAL"], trained, AS_OF, edits)
    assert {(r.ship_date, r.entity): r.total_volume for r in out.volumes.collect()}[(date(2021, 7, 1), "SOUTH")] == 40.0
    assert out.table.columns == ["ship_date", "MOON", "NORTH", "SOUTH"]  # what was uploaded, as a dense grid
    assert out.matrix.columns == ["ship_date", "NORTH-10T", "NORTH-20T", "SOUTH-10T", "SOUTH-20T"]
    assert sorted(r.ship_date for r in out.matrix.collect()) == [date(2021, 7, 1), date(2021, 7, 2)]
    assert [tuple(r) for r in out.missing.collect()] == [("MOON", 2)]


def test_history_run(spark, tables, trained):
    out = batch.from_history(read(spark, tables, "shipments"), read(spark, tables, "locations"), SIDE, trained, AS_OF)
    assert out.volumes.count() == 7 * 2
    assert out.matrix.count() == out.volumes.select("ship_date").distinct().count()
    assert out.missing.count() == 0


def test_accuracy_of_the_chosen_models(trained):
    assert sorted((r.entity, r.truck) for r in trained.accuracy.collect()) == [
        (e, t) for e in ("NORTH", "SOUTH") for t in ("10T", "20T")
    ]


def test_runs_count_only_the_asked_shipments(spark, tables):
    shipments, locations = read(spark, tables, "shipments"), read(spark, tables, "locations")
    mine = shipments.withColumns({"principal": F.lit("P"), "perspective": F.lit("S"), "domain_name": F.lit("BASE/X")})
    others = [mine.withColumn(c, F.lit("other")) for c in ("principal", "perspective", "domain_name")]
    for other in others:
        mine = mine.unionByName(other)
    keep = filters.SourceFilter("P", "S", domain_contains="BASE", location_domain_contains="D")
    out = batch.resolve(mine, locations, 25, AS_OF, True, keep)
    alone = batch.resolve(shipments, locations, 25, AS_OF, True)
    assert out.count() == alone.count() == 1190
    nowhere = filters.SourceFilter(location_domain_contains="none")
    assert batch.resolve(mine, locations, 25, AS_OF, True, nowhere).count() == 0


def test_empty_upload_shows_one_zero_row(spark, tables, trained):
    uploaded = read(spark, tables, "forecast")
    for rows in (uploaded, uploaded.limit(0)):
        out = batch.from_volumes(rows, ["NO SEGMENT"], trained, AS_OF)
        assert [(r.ship_date, r.entity, r.total_volume) for r in out.volumes.collect()] == [(AS_OF, "NORTH", 0.0)]
        assert out.matrix.count() == 1


def test_empty_history_is_named(spark, tables):
    shipments = read(spark, tables, "shipments").limit(0)
    with pytest.raises(ValueError, match="no rows"):
        batch.train(shipments, read(spark, tables, "locations"), SIDE, AS_OF, TINY, ("random_forest",))


def test_what_a_run_cannot_use_is_counted(spark, tables, trained):
    uploaded = read(spark, tables, "forecast")
    bad = uploaded.limit(1).withColumn("date_str", F.lit("no date"))
    day = date(2021, 7, 1)
    edits = [(day, "south", "NaN"), (day, "South", "41"), (day, "south", "1d"), (date(2030, 1, 1), "SOUTH", "5")]
    edits = spark.createDataFrame(edits, schemas.OVERRIDES)
    out = batch.from_volumes(uploaded.unionByName(bad), ["LOCAL"], trained, AS_OF, edits)
    assert {r.reason: r.n_rejected for r in out.rejected.collect()} == {
        "unreadable date": 1, "unreadable edit": 2, "edit without a cell": 1
    }
    assert out.volumes.where("entity = 'SOUTH' and total_volume = 41").count() == 1


def test_names_meet_in_upper_case_and_by_synonyms(spark, tables):
    places = read(spark, tables, "locations").withColumn("zone2", F.lower("zone2"))
    mixed = batch.train(read(spark, tables, "shipments"), places, SIDE, AS_OF, TINY, ("random_forest",))
    assert mixed.entities == ["NORTH", "SOUTH"]
    out = batch.from_volumes(read(spark, tables, "forecast"), ["LOCAL"], mixed, AS_OF, synonyms={"Moon": "North"})
    assert out.missing.count() == 0 and out.fleet.where("forecast > 0").count() > 0


def test_both_sides_from_one_read(spark, tables):
    customer = history.Side("customer", "dest_name", ("LOCAL-A", "CHAIN"), 1, 2)
    out = batch.train_sides(
        read(spark, tables, "shipments"), read(spark, tables, "locations"), [SIDE, customer], AS_OF, TINY, ("random_forest",)
    )
    assert out["region"].entities == ["NORTH", "SOUTH"]
    assert len(out["customer"].entities) == 2
    resolved = batch.resolve(read(spark, tables, "shipments"), read(spark, tables, "locations"), 25, AS_OF, True)
    with staged(batch.side_columns(resolved, [SIDE, customer]), "resolved", "segment") as rows:
        text = history.side_rows(rows, customer)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [segment" in text and "IN (LOCAL-A,CHAIN)" in text


def test_command_line(spark, tables, tmp_path, monkeypatch, trained):
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    monkeypatch.setattr(batch.train_sides, "__defaults__", (None, TINY, ("random_forest",), *batch.train_sides.__defaults__[3:]))
    side = tmp_path / "side.json"
    side.write_text(json.dumps({"name": "region", "entity_column": "dest_zone2", "segments": ["LOCAL-A", "LOCAL-B"], "top_trucks": 2}))
    history_args = ["--shipments", f"{tables}/shipments", "--locations", f"{tables}/locations", "--side", str(side)]
    models = ["--models", f"{tmp_path}/models"]
    cli.main(["--as-of", "2021-06-30", "train", *history_args, *models])
    assert Trained.load(f"{tmp_path}/models", "region", spark).entities == ["NORTH", "SOUTH"]
    cli.main(["--as-of", "2021-06-30", "history", *history_args, *models, "--out", f"{tmp_path}/h"])
    forecast = ["--forecast", f"{tables}/forecast", "--segments", "LOCAL", "--side-name", "region"]
    cli.main(["--as-of", "2021-06-30", "volumes", *forecast, *models, "--out", f"{tmp_path}/v"])
    assert spark.read.parquet(f"{tmp_path}/v/matrix").count() == 2
    assert spark.read.parquet(f"{tmp_path}/h/volumes").count() == 7
    assert Trained.load(f"{tmp_path}/models", "region", spark).accuracy.count() == 4
    long = spark.read.parquet(f"{tmp_path}/v/fleet")
    assert sorted(long.columns) == sorted(schemas.FLEET_LONG.names) and long.count() == 2 * 2 * 2


def test_hashed_split_is_stable_and_near_four_fifths(spark):
    days = spark.range(5000).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    chosen = days.where(metrics.is_training_row(7, "d"))
    assert 3800 < chosen.count() < 4200
    assert chosen.exceptAll(days.repartition(3).where(metrics.is_training_row(7, "d"))).count() == 0


def test_command_line_reads_a_database_in_time_slices(spark, tables, tmp_path, monkeypatch, trained):
    asked = {}

    def fake(session, table, options, split=None):
        asked[table] = (options, split)
        return session.read.parquet(f"{tables}/{table}")

    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    monkeypatch.setattr(cli.jdbc, "read_table", fake)
    options = tmp_path / "jdbc.json"
    options.write_text(json.dumps({"url": "jdbc:sqlserver://host", "user": "u", "password": "p"}))
    side = tmp_path / "side.json"
    side.write_text(json.dumps({"name": "region", "entity_column": "dest_zone2", "segments": ["LOCAL-A"], "top_trucks": 2}))
    trained.save(f"{tmp_path}/models", spark)
    cli.main(
        ["--as-of", "2021-06-30", "--jdbc", str(options), "--tasks", "7", "history", "--shipments", "shipments",
         "--locations", "locations", "--side", str(side), "--models", f"{tmp_path}/models", "--out", f"{tmp_path}/out"]
    )
    assert asked["shipments"][0]["driver"].endswith("SQLServerDriver")
    assert (asked["shipments"][1]["numPartitions"], asked["shipments"][1]["upperBound"]) == ("7", "2021-06-30 00:00:00")
    assert asked["locations"][1] is None
    assert spark.read.parquet(f"{tmp_path}/out/matrix").count() == 7
