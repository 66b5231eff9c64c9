"""Accuracy of a backtest, and the choice of model.

Input rows are (ship_date, entity, truck, model, actual, forecast), one per day
and key. A group is therefore one daily series: its length is the number of
days in the history and does not grow with the shipments, which bounds the
buffer of the exact percentiles below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.numbers import round_even


def _actual() -> Column:
    return F.col("actual").cast("double")


def _forecast() -> Column:
    return F.col("forecast").cast("double")


def _error() -> Column:
    return F.abs(_actual() - _forecast())


def mean() -> Column:
    return F.avg(_actual())


def sd() -> Column:
    return F.stddev_pop(_actual())


def cv() -> Column:
    return F.try_divide(sd(), mean())


def mae() -> Column:
    return F.avg(_error())


def mse() -> Column:
    return F.avg(_error() * _error())


def rmse() -> Column:
    return F.sqrt(mse())


def interquartile() -> Column:
    quartiles = F.percentile(_actual(), [0.25, 0.75])
    return F.element_at(quartiles, 2) - F.element_at(quartiles, 1)


def nrmse(kind: str) -> Column:
    """RMSE over a spread of the actuals, 3 places; NULL when the spread is 0."""
    spread = {
        "sd": sd,
        "mean": mean,
        "maxmin": lambda: F.max(_actual()) - F.min(_actual()),
        "iq": interquartile,
    }[kind]()
    return round_even(F.try_divide(rmse(), spread), 3)


def _relative(scale: Column) -> Column:
    # A zero actual has no relative error: a miss counts 1, a hit 0.
    miss = F.when(_forecast() != 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.avg(F.when(_actual() == 0, miss).otherwise(F.try_divide(_error(), scale)))


def mape() -> Column:
    """Mean absolute relative error, as a fraction."""
    return _relative(F.abs(_actual()))


def smape() -> Column:
    """Symmetric form, as a fraction and without the factor 2."""
    return _relative(F.abs(_actual()) + F.abs(_forecast()))


METRICS = {
    "mean": mean,
    "sd": sd,
    "cv": cv,
    "mae": mae,
    "mse": mse,
    "rmse": rmse,
    "nrmse_mean": lambda: nrmse("mean"),
    "nrmse_sd": lambda: nrmse("sd"),
    "nrmse_iq": lambda: nrmse("iq"),
    "mape": mape,
    "smape": smape,
}


def metric_table(backtest: DataFrame, places: int | None = None, clock: bool = False) -> DataFrame:
    """All metrics of every (entity, truck) in one aggregate."""
    columns = [
        (fn() if places is None else round_even(fn(), places)).alias(name) for name, fn in METRICS.items()
    ]
    out = backtest.groupBy("entity", "truck").agg(*columns)
    return out.withColumn("date_time", F.current_timestamp()) if clock else out


def model_mae(backtest: DataFrame) -> DataFrame:
    """MAE per entity and model: the plain mean over its truck types."""
    per_truck = backtest.groupBy("entity", "model", "truck").agg(mae().alias("mae"))
    return per_truck.groupBy("entity", "model").agg(F.avg("mae").alias("mae"))


def select_model(maes: DataFrame, order: list[str]) -> DataFrame:
    """Lowest MAE per entity; the earlier model in ``order`` wins a tie, unlisted ones come last. NULL errors never win."""
    position = F.array_position(F.array([F.lit(m) for m in order]), F.col("model"))
    rank = F.struct(F.col("mae"), F.when(position > 0, position).otherwise(len(order) + 1), F.col("model"))
    return maes.where(F.col("mae").isNotNull() & ~F.isnan("mae")).groupBy("entity").agg(F.min_by("model", rank).alias("model"), F.min("mae").alias("mae"))


def with_forecasts(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Actuals beside forecasts of the same day, entity and truck."""
    return actuals.join(forecasts, ["ship_date", "entity", "truck"], "inner")


def is_training_day(day: Column) -> Column:
    """Four days in five train, the fifth is held out: fixed by the date alone."""
    return F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(5)) < 4


def is_training_row(seed: int, *keys: str) -> Column:
    """Seeded 80/20 split by a hash of the key columns.

    Unlike a random split it does not depend on partitions or on retried tasks.
    """
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(100)) < 80
