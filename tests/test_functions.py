from datetime import date

import pytest
from pyspark.sql import functions as F

from haulcast.functions import dates, numbers, text


def values(df, column):
    return [row[column] for row in df.orderBy("i").select(column).collect()]


def frame(spark, items, dtype):
    return spark.createDataFrame(list(enumerate(items)), f"i int, x {dtype}")


def test_round_even_follows_numpy(spark):
    df = frame(spark, [2.345, 0.125, 2.675, 1234.565, None], "double")
    assert values(df.withColumn("r", numbers.round_even(F.col("x"), 2)), "r") == [2.35, 0.12, 2.68, 1234.56, None]


def test_whole_numbers_round_to_even(spark):
    df = frame(spark, [0.5, 1.5, -2.5], "double")
    assert values(df.withColumn("r", numbers.whole(F.col("x"))), "r") == [0, 2, -2]


def test_round_all_doubles_leaves_other_types(spark):
    df = spark.createDataFrame([(1, 2.345, "2.345", 7)], "i int, `a.b (c)` double, s string, n bigint")
    out = numbers.round_all_doubles(df)
    assert out.columns == df.columns
    assert tuple(out.first()) == (1, 2.35, "2.345", 7)


def test_edited_number(spark):
    df = frame(spark, ["12.5", " 7 ", "n/a", "", None, "1e3"], "string")
    assert values(df.withColumn("r", numbers.edited_number(F.col("x"))), "r") == [12.5, 7.0, None, None, None, 1000.0]


def test_forecast_dates(spark):
    df = frame(spark, ["2021/Feb/09", "2021/feb/28", "2021/Feb/30", "junk", None], "string")
    out = values(df.withColumn("r", dates.forecast_date(F.col("x"))), "r")
    assert out == [date(2021, 2, 9), date(2021, 2, 28), None, None, None]


def test_weekday_runs_from_monday_one_to_sunday_seven(spark):
    df = frame(spark, [date(2021, 2, 8), date(2021, 2, 14), date(2020, 2, 29)], "date").withColumnRenamed("x", "ship_date")
    rows = [(r.year, r.month, r.weekday) for r in dates.with_calendar(df).orderBy("i").collect()]
    assert rows == [(2021, 2, 1), (2021, 2, 7), (2020, 2, 6)]


@pytest.mark.parametrize("day", [date(2021, 2, 8), date(1999, 12, 31), date(2020, 2, 29)])
def test_labels_agree_and_come_back(spark, day):
    df = frame(spark, [day], "date").withColumn("label", dates.label(F.col("x")))
    row = df.withColumn("back", dates.label_to_date(F.col("label"))).first()
    assert row.label == dates.label_of(day)
    assert row.back == day


def test_month_windows_clip_at_month_end(spark):
    moment = dates.as_of_timestamp(date(2021, 3, 31))
    out = spark.range(1).select(dates.months_before(moment, 1).cast("date").alias("d")).first().d
    assert out == date(2021, 2, 28)


def test_short_truck_names(spark):
    gids = ["A/B.10T", "NODOT", "A.B.C", None]
    df = frame(spark, gids, "string")
    expected = ["10T", "NODOT", "B.C", None]
    assert values(df.withColumn("r", text.truck_short_name(F.col("x"))), "r") == expected
    assert [text.short_name(g) for g in gids[:3]] == expected[:3]
