"""History side against a plain-Python count, with the cases the tables lack."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest

from haulcast.functions.text import short_name
from haulcast.operators import abt
from haulcast.plans import history

SCHEMA = (
    "shipment_xid bigint, start_ts timestamp_ntz, total_volume double, equipment_gid string, "
    "segment string, dest_name string, dest_zone2 string"
)


def make_rows(n=4000, seed=3):
    """Shipments in which one customer and day hold a third of all rows."""
    rng = random.Random(seed)
    trucks = ["A.T1", "B.T1", "A.T2", "A.T3", "NODOT", "A.T5", None]
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        name = "HOT" if hot else rng.choice([f"C{j}" for j in range(12)] + ["C0 DC", None])
        day = datetime(2021, 1, 1) + timedelta(days=0 if hot else rng.randrange(20), hours=rng.randrange(24))
        rows.append(
            (
                rng.randrange(n // 2),
                day,
                None if rng.random() < 0.05 else float(rng.randrange(1, 50)),
                rng.choices(trucks, [6, 5, 4, 3, 2, 1, 2])[0],
                rng.choice(["S1", "S2", "OTHER"]),
                name,
                rng.choice(["R1", "R2"]),
            )
        )
    return rows


def expected(rows, side):
    kept = [list(r) for r in rows if r[4] in side.segments]
    column = {"dest_name": 5, "dest_zone2": 6}[side.entity_column]
    for r in kept:
        r[5] = side.synonyms.get(r[5], r[5])
    freq = Counter(r[3] for r in kept if r[3] is not None)
    trucks = sorted(freq, key=lambda t: (-freq[t], t))[: side.top_trucks]
    kept = [r for r in kept if r[3] is None or r[3] in trucks]
    if side.top_entities is not None:
        volume = defaultdict(float)
        for r in kept:
            if r[column] is not None:
                volume[r[column]] += r[2] or 0.0
        top = sorted(volume, key=lambda e: (-volume[e], e))[: side.top_entities]
        kept = [r for r in kept if r[column] is None or r[column] in top]
    volume, shipped = defaultdict(float), defaultdict(set)
    for xid, ts, vol, gid, _, *_rest in kept:
        entity = kept and _rest[column - 5]
        if entity is None:
            continue
        volume[(ts.date(), entity)] += vol or 0.0
        if gid is not None:
            shipped[(ts.date(), entity, short_name(gid))].add(xid)
    return trucks, volume, shipped


@pytest.mark.parametrize(
    "side",
    [
        history.customer_side(["S1", "S2"], {"C0 DC": "C0"}),
        history.region_side(["S1", "S2"]),
    ],
    ids=lambda s: s.name,
)
def test_base_table_matches_plain_count(spark, side):
    rows = make_rows()
    trucks, volume, shipped = expected(rows, side)
    opened = history.open_side(spark.createDataFrame(rows, SCHEMA), side)
    assert opened.kept_trucks == sorted(trucks)
    names = sorted({short_name(t) for t in trucks})
    assert opened.truck_names() == names
    table = opened.base_table().collect()
    assert {(r.ship_date, r.entity): r.total_volume for r in table} == dict(volume)
    for r in table:
        for name in names:
            assert r[name] == len(shipped.get((r.ship_date, r.entity, name), ()))
        assert (r.year, r.month, r.weekday) == (r.ship_date.year, r.ship_date.month, r.ship_date.isoweekday())


def test_long_form_keeps_zero_counts(spark):
    opened = history.open_side(spark.createDataFrame(make_rows(), SCHEMA), history.region_side(["S1"]))
    wide, long = opened.base_table(), opened.long_counts()
    assert long.count() == wide.count() * len(opened.truck_names())


def test_volume_of_only_nulls_is_zero(spark):
    rows = [(1, datetime(2021, 1, 1), None, "A.T1", "S1", "C", "R")]
    rows = history.side_rows(spark.createDataFrame(rows, SCHEMA), history.region_side(["S1"]))
    assert [tuple(r) for r in abt.daily_volume(rows).collect()] == [(date(2021, 1, 1), "R", 0.0)]


def test_equal_short_names_count_a_shipment_once(spark):
    rows = [
        (1, datetime(2021, 1, 1), 2.0, "A.T1", "S1", "C", "R"),
        (1, datetime(2021, 1, 1), 3.0, "B.T1", "S1", "C", "R"),
        (2, datetime(2021, 1, 1), 4.0, "B.T1", "S1", "C", "R"),
    ]
    row = history.open_side(spark.createDataFrame(rows, SCHEMA), history.region_side(["S1"])).base_table().first()
    assert (row.total_volume, row["T1"]) == (9.0, 2)


def test_empty_history(spark):
    opened = history.open_side(spark.createDataFrame([], SCHEMA), history.region_side(["S1"]))
    assert opened.kept_trucks == []
    assert opened.base_table().count() == 0


def test_clean_rounds_and_dates(spark):
    df = spark.createDataFrame([(1, datetime(2021, 1, 1, 23, 59), 2.345, "A.T1", "S1", "C", "R")], SCHEMA)
    row = history.clean(df).first()
    assert (row.total_volume, row.ship_date) == (2.35, date(2021, 1, 1))
