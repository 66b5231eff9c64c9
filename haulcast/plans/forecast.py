"""From daily volumes and fitted models to the fleet matrix."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulcast.functions.numbers import quoted, whole
from haulcast.functions.text import fleet_column_names
from haulcast.models.training import Trained
from haulcast.operators import reshape
from haulcast.plans import volume


def linear_rule(features: DataFrame, volume_per_truck: Mapping[str, float]) -> DataFrame:
    """Forecast by a fixed volume per truck: a stand-in where no model is fitted."""
    cells = [
        F.struct(F.lit(truck).alias("truck"), whole(F.col("total_volume") / F.lit(float(load))).alias("forecast"))
        for truck, load in volume_per_truck.items()
    ]
    return features.select("ship_date", "entity", F.explode(F.array(cells)).alias("cell")).select(
        "ship_date", "entity", "cell.truck", "cell.forecast"
    )


def matrix(features: DataFrame, fleet: DataFrame, entities: Sequence[str], trucks: Sequence[str]) -> DataFrame:
    """Wide matrix over every day of ``features``, listed entities only."""
    listed = fleet.where(F.col(quoted("entity")).isin(list(entities)))
    spine = reshape.spine_join(features, listed)
    return reshape.fleet_matrix(spine, fleet_column_names(list(entities), list(trucks)))


def forecast(trained: Trained, features: DataFrame) -> DataFrame:
    """Score a feature table with the fitted models and lay out the matrix."""
    return matrix(features, trained.score(features), trained.entities, trained.trucks)


def missing_entities(trained: Trained, features: DataFrame) -> DataFrame:
    """Entities in the input that no model covers, with their row counts."""
    known = trained.choices.select("entity")
    return features.join(known, "entity", "left_anti").groupBy("entity").agg(F.count("*").alias("n_rows"))


def rescored(fleet: DataFrame, changed: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fleet`` with the forecasts of the ``changed`` cells replaced: only those cells are scored."""
    fresh = score(volume.features(changed))
    stays = fleet.join(changed.select("ship_date", "entity"), ["ship_date", "entity"], "left_anti")
    return stays.unionByName(fresh.select(*fleet.columns))
