from datetime import date

import pytest
from pyspark.sql import functions as F

from haulcast import schemas
from haulcast.functions import dates
from haulcast.operators import reshape
from haulcast.plans import forecast, volume

D1, D2 = date(2021, 2, 8), date(2021, 2, 9)


@pytest.fixture()
def uploaded(spark):
    rows = [
        (3, "2021/Feb/09", "LOCAL", "South", 10.125),
        (1, "2021/Feb/08", "LOCAL", "south", 1.0),
        (2, "2021/Feb/08", "LOCAL", "SOUTH", 2.5),
        (4, "2021/Feb/08", "LOCAL", "East Coast", 7.0),
        (5, "2021/Xyz/08", "LOCAL", "SOUTH", 100.0),
        (6, "2021/Feb/08", "LOCAL", None, 100.0),
        (7, "2021/Feb/08", "CHAIN", "SOUTH", 100.0),
    ]
    return spark.createDataFrame(rows, "id int, date_str string, segment string, cust_region string, volume_forecast double")


def test_daily_volumes(uploaded):
    out = volume.daily(volume.parse(uploaded), ["LOCAL"]).orderBy("ship_date", "entity").collect()
    assert [tuple(r) for r in out] == [(D1, "EAST COAST", 7.0), (D1, "SOUTH", 3.5), (D2, "SOUTH", 10.12)]


def test_bad_dates_are_counted(uploaded):
    assert tuple(volume.rejected_dates(uploaded).first()) == (1, 7)


def test_pivot_unpivot_transpose(uploaded):
    names = ["EAST COAST", "SOUTH", "HILLS (x.y) z"]
    wide = reshape.volume_pivot(volume.daily(volume.parse(uploaded), ["LOCAL"]), names)
    assert sorted(tuple(r) for r in wide.collect()) == [(D1, 7.0, 3.5, 0.0), (D2, 0.0, 10.12, 0.0)]
    cells = {(r.ship_date, r.entity): r.total_volume for r in reshape.volume_unpivot(wide, names).collect()}
    assert len(cells) == 6 and cells[(D1, "SOUTH")] == 3.5
    shown = reshape.transpose_days(wide, names, [D1, D2])
    assert shown.columns == ["entity", "Feb 08 2021", "Feb 09 2021"]
    back = reshape.days_to_rows(shown, [dates.label_of(d) for d in (D1, D2)])
    assert {(r.ship_date, r.entity): r.total_volume for r in back.collect()} == cells


def test_what_if(spark, uploaded):
    volumes = volume.daily(volume.parse(uploaded), ["LOCAL"])
    edits = spark.createDataFrame(
        [(D1, "SOUTH", "50"), (D1, "SOUTH", "40"), (D1, "EAST COAST", "oops"), (D2, "NORTH", "9")], schemas.OVERRIDES
    )
    out = {(r.ship_date, r.entity): r.total_volume for r in volume.what_if(volumes, edits).collect()}
    assert out == {(D1, "SOUTH"): 50.0, (D1, "EAST COAST"): 7.0, (D2, "SOUTH"): 10.12}
    assert tuple(volume.rejected_edits(edits).first()) == (1, 4)


def test_matrix_keeps_days_and_columns(uploaded):
    feats = volume.features(volume.daily(volume.parse(uploaded), ["LOCAL"]))
    fleet = forecast.linear_rule(feats, {"10T": 2.0})
    out = forecast.matrix(feats, fleet, ["EAST COAST", "NORTH"], ["10T"])
    assert out.columns == ["ship_date", "EAST COAST-10T", "NORTH-10T"]
    # 7 / 2 = 3.5 rounds to 4; the second day has no listed entity and stays.
    assert sorted(tuple(r) for r in out.collect()) == [(D1, 4, 0), (D2, 0, 0)]


def test_dedup_keeps_equal_forecasts_of_different_days(spark):
    df = spark.createDataFrame([(D1, 1), (D1, 1), (D2, 1)], "ship_date date, n int")
    assert reshape.dedup_matrix(df).count() == 2


def test_error_widths(spark):
    df = spark.createDataFrame([(5.0, 9.0, 4.0)], "y double, ub double, lb double")
    row = reshape.error_widths(df, "y", "ub", "lb").first()
    assert (row.error_up, row.error_down) == (4.0, 1.0)


def test_features_are_named(uploaded):
    out = volume.features(volume.daily(volume.parse(uploaded), ["LOCAL"]))
    assert out.columns == ["ship_date", "entity", "total_volume", "year", "month", "weekday"]
    assert out.where(F.col("weekday") == 1).count() == 2


def test_grid_has_every_cell_and_edits_reach_empty_ones(spark, uploaded):
    volumes = volume.daily(volume.parse(uploaded), ["LOCAL"])
    grid = reshape.volume_grid(volumes, ["EAST COAST", "SOUTH"])
    expected = {(D1, "EAST COAST"): 7.0, (D1, "SOUTH"): 3.5, (D2, "EAST COAST"): 0.0, (D2, "SOUTH"): 10.12}
    assert {(r.ship_date, r.entity): r.total_volume for r in grid.collect()} == expected
    edits = spark.createDataFrame([(D2, "EAST COAST", "9")], schemas.OVERRIDES)
    edited = {(r.ship_date, r.entity): r.total_volume for r in volume.what_if(grid, edits).collect()}
    assert edited == expected | {(D2, "EAST COAST"): 9.0}
    wide = reshape.volume_pivot(volumes, ["EAST COAST", "SOUTH"])
    again = reshape.volume_unpivot(wide, ["EAST COAST", "SOUTH"])
    assert {(r.ship_date, r.entity): r.total_volume for r in again.collect()} == expected


def test_grid_without_names_or_days_is_empty(uploaded):
    volumes = volume.daily(volume.parse(uploaded), ["NOWHERE"])
    assert reshape.volume_grid(volumes, ["SOUTH"]).count() == 0
