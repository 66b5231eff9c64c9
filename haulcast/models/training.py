"""Training: every candidate for every entity and truck, one choice per entity.

An entity and a truck make a unit with a model of its own per candidate, grown on
that unit's training days alone. All units of a side are fitted by one job, however
many entities there are: Spark brings the days of a unit together, a task grows
its trees. The base table is written to the shared folder first: the fits read days
times entities rows, never the shipment history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.functions.numbers import whole
from haulcast.models import scoring, store
from haulcast.models.candidates import CANDIDATES, Ensemble, Settings, Unit
from haulcast.operators import abt, filters, metrics
from haulcast.plans.history import SideHistory
from haulcast.staging import stage_table, staged

#: Entities times trucks that one task fits, at some seconds each.
UNITS_PER_TASK = 32


@dataclass
class Trained:
    """Fitted models of one side and the candidate chosen for each entity.

    ``nodes`` is the node table of all models, ``choices`` a table (entity, model, mae) with one
    row per entity. ``trucks`` and ``entities`` name the columns of wide results.
    """

    side: str
    trucks: list[str]
    entities: list[str]
    nodes: DataFrame
    choices: DataFrame | None = None
    accuracy: DataFrame | None = None  # metrics of each entity's own model on the held-out rows

    def candidates(self) -> list[str]:
        present = {row.candidate for row in self.nodes.select("candidate").distinct().collect()}  # five at most
        return [c for c in CANDIDATES if c in present]

    def backtest(self, holdout: DataFrame, rounded: bool = True) -> DataFrame:
        """Actual and forecast of every candidate on held-out rows of the base table."""
        raw = scoring.forecasts(self.nodes, holdout, ["ship_date", "entity"], dates.FEATURES)
        actuals = abt.long_counts(holdout, self.trucks).select(
            "ship_date", "entity", "truck", F.col("n_shipments").cast("double").alias("actual")
        )
        forecast = F.rint("raw") if rounded else F.col("raw")
        return raw.join(actuals, ["ship_date", "entity", "truck"]).select(
            "ship_date", "entity", "truck", F.col("candidate").alias("model"), "actual", forecast.alias("forecast")
        )

    def score(self, features: DataFrame) -> DataFrame:
        """Whole trucks per day, entity and truck, by each entity's own model.

        Entities without a model give no rows; ``forecast.missing_entities`` counts them.
        """
        own = self.choices.select("entity", F.col("model").alias("candidate"))
        mine = self.nodes.join(own, ["entity", "candidate"], "left_semi")
        raw = scoring.forecasts(mine, features, ["ship_date", "entity"], dates.FEATURES)
        return raw.select("ship_date", "entity", "truck", whole(F.col("raw")).alias("forecast"))

    def save(self, path: str, spark: SparkSession) -> None:
        """Publish all tables as one version: readers see it whole or not at all."""
        entities = spark.createDataFrame(list(enumerate(self.entities)), "i int, name string")
        trucks = spark.createDataFrame(list(enumerate(self.trucks)), "i int, name string")
        tables = {"nodes": self.nodes, "entities": entities, "trucks": trucks}
        optional = {"choices": self.choices, "accuracy": self.accuracy}
        tables |= {name: table for name, table in optional.items() if table is not None}
        holds = [(name,) for name in tables]
        tables["tables"] = spark.createDataFrame(holds, "name string")
        store.publish(spark, _base(path, self.side), tables)

    @staticmethod
    def load(path: str, side: str, spark: SparkSession) -> Trained:
        folder = store.current(spark, _base(path, side))

        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{folder}/{name}")

        def names(name: str) -> list[str]:
            return [r.name for r in sorted(table(name).collect())]

        holds = {r.name for r in table("tables").collect()}
        optional = [table(name) if name in holds else None for name in ("choices", "accuracy")]
        return Trained(side, names("trucks"), names("entities"), table("nodes"), *optional)


def _base(path: str, side: str) -> str:
    return f"{path}/{quote(side, safe='')}"


def training_rows(train: DataFrame, trucks: Sequence[str]) -> DataFrame:
    """(entity, truck, seed, day, features..., y): one row per unit and day."""
    long = abt.long_counts(train, list(trucks))
    numbers = [F.col(f).cast("double").alias(f) for f in dates.FEATURES]
    y, seed = F.col("n_shipments").cast("double").alias("y"), F.xxhash64("entity", "truck").alias("seed")
    return long.select("entity", "truck", seed, F.unix_date("ship_date").alias("day"), *numbers, y)


def _fit_unit(candidates: Sequence[str], settings: Settings) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("day")
        features = np.stack([rows[f].to_numpy() for f in dates.FEATURES], axis=1)
        unit = Unit(features, rows["y"].to_numpy(), rows["seed"][0].as_py())
        names = [rows[c][0].as_py() for c in ("entity", "truck")]
        return pa.concat_tables([_table(names, c, CANDIDATES[c](unit, settings)) for c in candidates])

    return run


def _table(names: list[str], candidate: str, model: Ensemble) -> pa.Table:
    """Rows of the node table."""
    nodes, n = model.nodes, len(model.share)
    leaf = nodes.feature < 0
    text = [pa.array([value] * n, pa.string()) for value in (*names, candidate)]
    level = np.array([int(i).bit_length() - 1 for i in nodes.node.tolist()], np.int32)
    columns = [
        *text,
        pa.array(nodes.tree, pa.int32()),
        pa.array(nodes.node, pa.int64()),
        pa.array(level),
        pa.array(nodes.feature, pa.int32(), mask=leaf),
        pa.array(nodes.cut, pa.float64(), mask=leaf),
        pa.array(2 * nodes.node, pa.int64(), mask=leaf),
        pa.array(2 * nodes.node + 1, pa.int64(), mask=leaf),
        pa.array(nodes.value, pa.float64()),
        pa.array(model.share, pa.float64()),
    ]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in scoring.NODES.split(", ")])


def fit(
    side: str,
    base_table: DataFrame,
    trucks: Sequence[str],
    entities: Sequence[str],
    candidates: Sequence[str] = tuple(CANDIDATES),
    settings: Settings = Settings(),
    is_train: Column | None = None,
) -> Trained:
    """Fit every candidate for every entity and truck on the training rows of ``base_table``.

    One job: rows meet by (entity, truck), a series of days, and become the trees of all candidates.
    """
    if not trucks:
        return Trained(side, [], list(entities), base_table.sparkSession.createDataFrame([], scoring.NODES))
    train = base_table.where(_training(is_train) & F.col("entity").isin(list(entities)))
    rows = training_rows(train, trucks)
    # A unit is little data and much work: their number, not their bytes, says how many tasks there are.
    least = int(base_table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-len(entities) * len(trucks) // UNITS_PER_TASK))
    units = rows.repartition(parts, "entity", "truck").groupBy("entity", "truck")
    nodes = units.applyInArrow(_fit_unit(tuple(candidates), settings), scoring.NODES)
    return Trained(side, list(trucks), list(entities), stage_table(nodes, f"nodes-{side}"))


def choose(trained: Trained, base_table: DataFrame, is_train: Column | None = None) -> DataFrame:
    """Best candidate per entity on the held-out rows, by mean MAE over trucks.

    An entity of the history without held-out rows takes the first candidate.
    """
    return choose_by(trained, trained.backtest(base_table.where(~_training(is_train)), rounded=False), base_table)


def choose_by(trained: Trained, backtest: DataFrame, base_table: DataFrame) -> DataFrame:
    """The same from a backtest of raw forecasts."""
    order = trained.candidates()
    best = metrics.select_model(metrics.model_mae(backtest), order)
    known = base_table.where(F.col("entity").isin(trained.entities)).select("entity").distinct()
    return known.join(best, "entity", "left").select("entity", F.coalesce("model", F.lit(order[0])).alias("model"), "mae")


def _training(is_train: Column | None) -> Column:
    return metrics.is_training_day(F.col("ship_date")) if is_train is None else is_train


def own_accuracy(trained: Trained, backtest: DataFrame) -> DataFrame:
    """Metrics of each entity's own model on a backtest of raw forecasts, in whole trucks."""
    own = trained.choices.select("entity", "model")
    held = backtest.withColumn("forecast", F.rint("forecast")).join(own, ["entity", "model"], "left_semi")
    return metrics.metric_table(held, clock=True)


def train_all(
    history: SideHistory,
    entities: Sequence[str] | None = None,
    settings: Settings = Settings(),
    candidates: Sequence[str] = tuple(CANDIDATES),
    is_train: Column | None = None,
) -> Trained:
    """Fit, compare and choose for every entity of a side.

    ``entities`` restricts the side to an allow-list; else the names in the base
    table are used.
    """
    trucks, side = history.truck_names(), history.side.name
    with staged(history.base_table(trucks), f"abt-{side}") as base:
        if entities is None:
            entities = history.kept_entities or filters.names(base, "entity")
        trained = fit(side, base, trucks, entities, candidates, settings, is_train)
        if not trained.candidates():
            raise ValueError(f"side {side}: the training window holds no rows of its segments")
        held = stage_table(trained.backtest(base.where(~_training(is_train)), rounded=False), f"backtest-{side}")
        trained.choices = stage_table(choose_by(trained, held, base), f"choice-{side}")
        trained.accuracy = stage_table(own_accuracy(trained, held), f"accuracy-{side}")
    return trained
