"""Types found in CSV files."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from haulcast.sources import inference

TABLE = '''flag,whole,number,day,moment,text,mixed,empty,long one,"quoted ""name"""
true,1,1,2021-02-09,2021-02-09 10:11:12.5,x,1,,123456789012345678,a
FALSE,-2,2.5e3,2020-02-29,2021-02-09T10:11:12,,2021-02-09,,1234567890123456789,b
,,,,,"",true,,,
'''


@pytest.fixture
def path(tmp_path):
    (tmp_path / "t.csv").write_text(TABLE)
    return f"file://{tmp_path}/t.csv"


def test_types_and_values(spark, path):
    df = inference.read_csv_inferred(spark, path)
    assert dict(df.dtypes) == {
        "flag": "boolean",
        "whole": "bigint",
        "number": "double",
        "day": "date",
        "moment": "timestamp_ntz",
        "text": "string",
        "mixed": "string",
        "empty": "string",
        "long one": "double",
        'quoted "name"': "string",
    }
    rows = [tuple(r)[:7] for r in df.collect()]
    assert rows == [
        (True, 1, 1.0, date(2021, 2, 9), datetime(2021, 2, 9, 10, 11, 12, 500000), "x", "1"),
        (False, -2, 2500.0, date(2020, 2, 29), datetime(2021, 2, 9, 10, 11, 12), None, "2021-02-09"),
        (None, None, None, None, None, "", "true"),
    ]


def test_refused_cells_are_counted(spark, path):
    report = {r.column_name: r for r in inference.column_types(inference.read_text_columns(spark, path)).collect()}
    mixed = report["mixed"]
    assert (mixed.n_cells, mixed.n_empty) == (3, 0)
    assert (mixed.not_boolean, mixed.not_bigint, mixed.not_double, mixed.not_date, mixed.not_timestamp_ntz) == (2, 2, 2, 2, 2)
    assert report["day"].not_timestamp_ntz == 0 and report["moment"].not_date == 2
    assert (report["empty"].n_cells, report["empty"].n_empty) == (0, 3)


def test_days_that_do_not_exist_are_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("d\n2021-02-30\n")
    assert inference.read_csv_inferred(spark, f"file://{tmp_path}/t.csv").dtypes == [("d", "string")]


def test_line_breaks_in_cells_only_when_asked_for(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"one\ntwo",3\n')
    df = inference.read_csv_inferred(spark, f"file://{tmp_path}/t.csv", line_breaks=True)
    assert [tuple(r) for r in df.collect()] == [("one\ntwo", 3)]


def test_a_file_is_split_over_tasks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "1,some text\n" * 50_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        text = inference.read_text_columns(spark, f"file://{tmp_path}/t.csv")
        assert text.rdd.getNumPartitions() > 4
        assert text.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_header_alone(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    df = inference.read_csv_inferred(spark, f"file://{tmp_path}/t.csv")
    assert (df.dtypes, df.count()) == ([("a", "string"), ("b", "string")], 0)
