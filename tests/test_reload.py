"""The store kept by day against runs over all rows."""

from __future__ import annotations

import re
from datetime import date, timedelta
from pathlib import Path

import pytest
from haulcast.plans import history, reload
from haulcast.staging import new_path
from pyspark.sql import functions as F

SCHEMA = "ship_date date, entity string, equipment_gid string, shipment_xid bigint, total_volume double"
DAYS = [date(2021, 3, 1) + timedelta(days=i) for i in range(6)]
SIDE = history.Side("customer", "x", ("S",), 2, 2)


def some_rows(shift=0):
    rows = []
    for i in range(240):
        gid = [None, "D.10T", "D.10T", "D.20T", "D.1T", "D.20T"][(i + shift) % 6]
        rows.append((DAYS[i % 6], ["A", "B", "C", None][i % 4], gid, [None, i % 50][i % 7 > 0], float(i % 11)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def full(spark, rows):
    """Base table by the run over all rows."""
    df = frame(spark, rows)
    profiled = history.profile(df)
    trucks = history.top_trucks(profiled, SIDE.top_trucks)
    names = history.topk.top_names(history.top_entities(profiled, trucks, SIDE.top_entities), "entity")
    opened = history.SideHistory(SIDE, df, history._kept_trucks(trucks), names)
    return opened.base_table()


def same(left, right):
    assert left.columns == right.columns
    assert sorted(map(repr, left.collect())) == sorted(map(repr, right.collect()))


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path.removeprefix("file:")).rglob("*.parquet")}


def test_late_rows_replace_their_days_only(spark):
    path, rows = new_path(spark, "daily"), some_rows()
    reload.load_all(path, frame(spark, [r for r in rows if r[0] != DAYS[4]]))
    before = files_of(path)
    corrected = [(d, e, g, x, v + 5 if d == DAYS[2] else v) for d, e, g, x, v in rows]
    reload.reload_days(spark, path, frame(spark, corrected), [DAYS[2], DAYS[4]])
    after = files_of(path)
    stayed = {p for p in before if not any(f"ship_date={d}" in p for d in (DAYS[2], DAYS[4]))}
    assert stayed and all(after[p] == before[p] for p in stayed)
    same(reload.base_table(reload.stored(spark, path), SIDE), full(spark, corrected))


def test_a_day_without_rows_becomes_empty(spark):
    path, rows = new_path(spark, "daily"), some_rows()
    reload.reload_days(spark, path, frame(spark, rows), DAYS)
    left = [r for r in rows if r[0] != DAYS[0]]
    reload.reload_days(spark, path, frame(spark, left), [DAYS[0]])
    same(reload.base_table(reload.stored(spark, path), SIDE), full(spark, left))


def test_days_that_are_not_named_stay(spark):
    path = new_path(spark, "daily")
    reload.reload_days(spark, path, frame(spark, some_rows()), DAYS)
    reload.reload_days(spark, path, frame(spark, some_rows(shift=1)), DAYS[:1])
    mixed = [r for r in some_rows(shift=1) if r[0] == DAYS[0]] + [r for r in some_rows() if r[0] != DAYS[0]]
    same(reload.base_table(reload.stored(spark, path), SIDE), full(spark, mixed))


def test_the_read_is_pruned_to_the_changed_days(spark, tmp_path):
    frame(spark, some_rows()).write.partitionBy("ship_date").parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    changed = rows.where(F.col("ship_date").isin(DAYS[:1]))
    plan = reload.daily_sums(changed)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*ship_date", plan)


def test_kinds_of_one_short_name_are_refused(spark):
    path = new_path(spark, "daily")
    rows = [(DAYS[0], "A", g, 1, 1.0) for g in ("D.10T", "E.10T")]
    reload.reload_days(spark, path, frame(spark, rows), DAYS[:1])
    with pytest.raises(ValueError, match="short name"):
        reload.base_table(reload.stored(spark, path), SIDE)
