from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from haulcast.operators import filters, topk


def days(spark, items):
    return spark.createDataFrame([(d,) for d in items], "ship_date date")


def test_fallback_keeps_current_rows(spark):
    df = days(spark, [date(2021, 1, 1), date(2021, 2, 1), date(2021, 2, 2), None])
    out = filters.current_or_all(df, "ship_date", date(2021, 2, 1))
    assert sorted(r.ship_date for r in out.collect()) == [date(2021, 2, 1), date(2021, 2, 2)]


def test_fallback_returns_everything_when_all_is_past(spark):
    df = days(spark, [date(2021, 1, 1), date(2021, 2, 1), None])
    assert filters.current_or_all(df, "ship_date", date(2022, 1, 1)).count() == 3


def test_fallback_on_empty_table(spark):
    assert filters.current_or_all(days(spark, []), "ship_date", date(2022, 1, 1)).count() == 0


def test_trailing_window_bounds(spark):
    rows = [datetime(2021, 2, 28, 0, 0), datetime(2021, 2, 27, 23, 59), datetime(2021, 3, 31), datetime(2021, 4, 1)]
    df = spark.createDataFrame([(r,) for r in rows], "start_ts timestamp_ntz")
    closed = filters.trailing_months(df, "start_ts", 1, date(2021, 3, 31), closed=True)
    opened = filters.trailing_months(df, "start_ts", 1, date(2021, 3, 31), closed=False)
    assert closed.count() == 2
    assert opened.count() == 3


def test_canonical_names(spark):
    df = spark.createDataFrame([("X DC", 1), ("X", 2), (None, 3), ("Y", 4)], "entity string, n int")
    pairs = spark.createDataFrame([("X DC", "X")], "variant string, name string")
    expected = [("X", 1), ("X", 2), (None, 3), ("Y", 4)]
    by_table = filters.canonicalise(df, pairs, "entity").orderBy("n").collect()
    by_mapping = df.select(filters.canonical(F.col("entity"), {"X DC": "X"}).alias("entity"), "n").orderBy("n").collect()
    assert [tuple(r) for r in by_table] == expected
    assert [tuple(r) for r in by_mapping] == expected


def test_allow_list_with_repeats_does_not_multiply(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "entity string, n int")
    listed = spark.createDataFrame([("a",), ("a",)], "name string")
    assert [tuple(r) for r in filters.allowed_entities(df, listed).collect()] == [("a", 1)]


def test_uncovered_counts_what_a_list_leaves_out(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "entity string")
    assert [tuple(r) for r in filters.uncovered(df, ["a"]).collect()] == [("b", 2)]


def test_default_row_only_when_empty(spark):
    df = spark.createDataFrame([(date(2021, 1, 1), 5.0)], "ship_date date, total_volume double")
    default = {"ship_date": F.lit("2020-01-01"), "total_volume": F.lit(0)}
    assert [tuple(r) for r in filters.or_default(df, default).collect()] == [(date(2021, 1, 1), 5.0)]
    assert [tuple(r) for r in filters.or_default(df.where("false"), default).collect()] == [(date(2020, 1, 1), 0.0)]


def test_rows_without_a_key_survive_top_k(spark):
    df = spark.createDataFrame([("x",), ("x",), ("x",), (None,), ("y",)], "k string")
    top = topk.top_k(topk.frequencies(df, "k"), "k", "n_rows", 1)
    assert sorted(r.k or "" for r in topk.keep_top(df, "k", top).collect()) == ["", "x", "x", "x"]
    assert [r.k for r in topk.drop_top(df, "k", top).collect()] == ["y"]


def test_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 9.0)], "k string, v double")
    assert [r.k for r in topk.top_k(df, "k", "v", 2).collect()] == ["c", "a"]


def test_last_and_first_rows(spark):
    df = spark.createDataFrame([(d, e) for d in (1, 2, 3) for e in "ab"], "d int, e string")
    assert sorted(tuple(r) for r in topk.last_rows(df, 3, ["d", "e"]).collect()) == [(2, "b"), (3, "a"), (3, "b")]
    assert [tuple(r) for r in topk.first_rows(df, 2, ["d", "e"]).collect()] == [(1, "a"), (1, "b")]


def test_names_on_the_driver(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "entity string")
    assert filters.names(df, "entity") == ["a", "b"]


def test_variant_with_two_names_fails_and_repeats_do_not_multiply(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "entity string, n int")
    pairs = spark.createDataFrame([("x", "z"), ("x", "z")], "variant string, name string")
    assert sorted(tuple(r) for r in filters.canonicalise(df, pairs, "entity").collect()) == [("y", 2), ("z", 1)]
    with pytest.raises(Exception, match="two names for x"):
        filters.canonicalise(df, pairs.unionByName(pairs.withColumn("name", F.lit("w"))), "entity").collect()


def test_top_k_by_a_column_with_a_dot(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "`a.b` string, n int")
    top = df.where("n = 1").select("`a.b`")
    assert [tuple(r) for r in topk.drop_top(df, "a.b", top).collect()] == [("y", 2)]
    assert [tuple(r) for r in topk.keep_top(df, "a.b", top).collect()] == [("x", 1)]
