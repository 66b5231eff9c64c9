from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haulcast.operators import metrics


BACKTEST = "ship_date date, entity string, truck string, model string, actual double, forecast double"


def series(spark, pairs, entity="E", truck="T", model="m"):
    rows = [(date(2021, 1, 1) + timedelta(days=i), entity, truck, model, float(a), float(f)) for i, (a, f) in enumerate(pairs)]
    return spark.createDataFrame(rows, BACKTEST)


def test_zero_rules(spark):
    row = series(spark, [(0, 0), (0, 3), (4, 3)]).agg(metrics.mape().alias("m"), metrics.smape().alias("s")).first()
    assert row.m == pytest.approx((0 + 1 + 0.25) / 3)
    assert row.s == pytest.approx((0 + 1 + 1 / 7) / 3)


def test_spread_measures(spark):
    df = series(spark, [(1, 1), (2, 2), (3, 3), (10, 10)])
    row = df.agg(metrics.sd().alias("sd"), metrics.interquartile().alias("iq"), metrics.mae().alias("mae")).first()
    assert row.sd == pytest.approx(3.5355339)
    assert row.iq == 3.0
    assert row.mae == 0.0


def test_nrmse_kinds(spark):
    df = series(spark, [(1, 2), (2, 3), (3, 4), (10, 11)])
    row = df.agg(*[metrics.nrmse(k).alias(k) for k in ("sd", "mean", "maxmin", "iq")]).first()
    assert tuple(row) == (0.283, 0.25, 0.111, 0.333)


def test_no_spread_gives_null(spark):
    row = metrics.metric_table(series(spark, [(0, 0), (0, 1)])).first()
    assert (row.cv, row.nrmse_mean, row.nrmse_sd, row.nrmse_iq) == (None, None, None, None)
    assert (row.mape, row.smape) == (0.5, 0.5)


def test_metric_table_has_a_row_per_truck_and_a_clock_on_request(spark):
    df = series(spark, [(1, 1), (3, 1)], truck="A").unionByName(series(spark, [(2, 2)], truck="B"))
    out = metrics.metric_table(df, places=2, clock=True)
    assert out.count() == 2
    assert len(out.columns) == 14


def test_model_choice_averages_trucks_and_settles_ties(spark):
    df = (
        series(spark, [(10, 10)], truck="A", model="late")
        .unionByName(series(spark, [(10, 4)], truck="B", model="late"))
        .unionByName(series(spark, [(10, 7)], truck="A", model="early"))
        .unionByName(series(spark, [(10, 7)], truck="B", model="early"))
    )
    out = metrics.select_model(metrics.model_mae(df), ["early", "late"]).first()
    assert tuple(out) == ("E", "early", 3.0)


def test_four_days_in_five_train(spark):
    days = spark.range(1000).select(F.date_add(F.lit("1965-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert days.where(metrics.is_training_day(F.col("d"))).count() == 800


def test_forecasts_join_on_the_full_key(spark):
    actual = series(spark, [(1, 0)]).select("ship_date", "entity", "truck", "actual")
    predicted = series(spark, [(0, 5)], truck="T").select("ship_date", "entity", "truck", "forecast")
    other = series(spark, [(0, 9)], truck="U").select("ship_date", "entity", "truck", "forecast")
    out = metrics.with_forecasts(actual, predicted.unionByName(other)).collect()
    assert [(r.actual, r.forecast) for r in out] == [(1.0, 5.0)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=40))
def test_metrics_agree_with_numpy(spark, pairs):
    a, f = (np.array(x, dtype=float) for x in zip(*pairs))
    row = metrics.metric_table(series(spark, pairs)).first()
    rmse = np.sqrt(np.mean((a - f) ** 2))
    assert row.mean == pytest.approx(a.mean())
    assert row.sd == pytest.approx(a.std(), abs=1e-12)
    assert row.mae == pytest.approx(np.abs(a - f).mean())
    assert row.rmse == pytest.approx(rmse)
    spread = np.quantile(a, 0.75) - np.quantile(a, 0.25)
    assert row.nrmse_iq == (None if spread == 0 else pytest.approx(np.round(rmse / spread, 3)))
