"""The three batch runs: train on history, forecast from history, forecast from uploaded volumes.

Each is one function that a scheduler calls; nothing is kept between calls but
the stored models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.models.candidates import CANDIDATES, Settings
from haulcast.models.training import Trained, train_all
from haulcast.operators import filters, joins, reshape, topk
from haulcast.plans import forecast, history, volume
from haulcast.staging import stage_table, staged

TRAINING_MONTHS = 25
RECENT_MONTHS = 1
HORIZON_DAYS = 7


@dataclass(frozen=True)
class FleetForecast:
    """What one run shows: daily volumes, their wide table, the fleet in long form and as a matrix.

    ``rejected`` counts what a run could not use, one row per reason: dates and
    edits that cannot be read, and edits of cells that the table does not have.
    ``missing`` lists entities without a model.
    """

    volumes: DataFrame
    table: DataFrame
    fleet: DataFrame
    matrix: DataFrame
    missing: DataFrame
    rejected: DataFrame


def resolve(
    shipments: DataFrame,
    locations: DataFrame,
    months: int,
    as_of: date | None,
    closed: bool,
    keep: filters.SourceFilter = filters.SourceFilter(),
) -> DataFrame:
    """Cleaned shipments of the last months that ``keep`` lets through, with their destination."""
    recent = filters.trailing_months(keep.shipments(shipments), "start_ts", months, as_of, closed)
    recent = recent.drop(filters.DAY)  # set anew from the start time
    return history.clean(joins.with_destination(recent, keep.locations(locations), "inner"))


def train(
    shipments: DataFrame,
    locations: DataFrame,
    side: history.Side,
    as_of: date | None = None,
    settings: Settings = Settings(),
    candidates: tuple[str, ...] = tuple(CANDIDATES),
    keep: filters.SourceFilter = filters.SourceFilter(),
    is_train: Column | None = None,
) -> Trained:
    """Models of one side from the last 25 months."""
    return train_sides(shipments, locations, [side], as_of, settings, candidates, keep, is_train)[side.name]


def train_sides(
    shipments: DataFrame,
    locations: DataFrame,
    sides: Sequence[history.Side],
    as_of: date | None = None,
    settings: Settings = Settings(),
    candidates: tuple[str, ...] = tuple(CANDIDATES),
    keep: filters.SourceFilter = filters.SourceFilter(),
    is_train: Column | None = None,
) -> dict[str, Trained]:
    """Models of several sides from one read of the shipments.

    The joined, narrow rows are written once, split by segment; every side then
    reads only the folders of its own segments. A database is asked only once.
    Each side also gets its accuracy table from the same base table.
    """
    resolved = resolve(shipments, locations, TRAINING_MONTHS, as_of, closed=True, keep=keep)
    with staged(side_columns(resolved, sides), "resolved", "segment") as rows:
        return {
            side.name: train_all(
                history.open_side(rows, side), settings=settings, candidates=candidates, is_train=is_train
            )
            for side in sides
        }


def side_columns(resolved: DataFrame, sides: Sequence[history.Side]) -> DataFrame:
    """Only the columns and segments that ``sides`` use."""
    segments = sorted({segment for side in sides for segment in side.segments})
    entities = sorted({side.entity_column for side in sides})
    return filters.in_segments(resolved, segments).select(
        "start_ts", *entities, "equipment_gid", "shipment_xid", "total_volume", "segment"
    )


def _shown(trained: Trained, volumes: DataFrame, overrides: DataFrame | None, rejected: list[DataFrame]) -> FleetForecast:
    """Lay out the grid of days and entities, edit it, score it."""
    grid = reshape.volume_grid(volumes)
    if overrides is not None:
        bad = volume.rejected_edits(overrides).select(F.lit("unreadable edit").alias("reason"), "n_rejected")
        lost = volume.unmatched_edits(grid, overrides).select(F.lit("edit without a cell"), "n_unmatched")
        rejected = [*rejected, bad, lost]
    edited = stage_table(grid if overrides is None else volume.what_if(grid, overrides), "volumes")
    features = volume.features(edited)
    fleet = stage_table(trained.score(features), "fleet")
    counts = rejected or [edited.sparkSession.createDataFrame([], "reason string, n_rejected long")]
    return FleetForecast(
        edited,
        reshape.volume_pivot(edited, filters.names(edited, "entity")),
        fleet,
        forecast.matrix(features, fleet, trained.entities, trained.trucks),
        forecast.missing_entities(trained, features),
        stage_table(reduce(DataFrame.unionAll, counts), "rejected"),
    )


def from_history(
    shipments: DataFrame,
    locations: DataFrame,
    side: history.Side,
    trained: Trained,
    as_of: date | None = None,
    overrides: DataFrame | None = None,
    keep: filters.SourceFilter = filters.SourceFilter(),
) -> FleetForecast:
    """Score the last rows of the recent base table, seven per entity."""
    resolved = resolve(shipments, locations, RECENT_MONTHS, as_of, closed=False, keep=keep)
    with staged(side_columns(resolved, [side]), "recent", "segment") as rows:
        table = history.open_side(rows, side).base_table(trained.trucks)
        tail = topk.last_rows(
            table.select("ship_date", "entity", "total_volume"),
            HORIZON_DAYS * len(trained.entities),
            ["ship_date", "entity"],
        )
        with staged(tail, "tail") as volumes:
            return _shown(trained, volumes, overrides, [])


def from_volumes(
    uploaded: DataFrame,
    segments: list[str],
    trained: Trained,
    as_of: date | None = None,
    overrides: DataFrame | None = None,
    synonyms: Mapping[str, str] | None = None,
) -> FleetForecast:
    """Score the uploaded forecast table, with edited cells in place of uploaded ones.

    Names follow the rule of the history, ``synonyms`` included. An upload
    without a row of the asked segments shows one row of volume 0.
    """
    side = history.Side("", "", (), 0, synonyms=dict(synonyms or {}))
    loaded = volume.load(uploaded, as_of)
    loaded = loaded.withColumn("entity", history.entity_key(F.col("entity"), side))
    default = {
        "ship_date": dates.as_of_date(as_of),
        "entity": F.lit(trained.entities[0] if trained.entities else "NONE"),
        "total_volume": F.lit(0.0),
    }
    rows = filters.or_default(volume.daily(loaded, segments), default)
    bad = volume.rejected_dates(uploaded).select(F.lit("unreadable date").alias("reason"), "n_rejected")
    with staged(rows, "uploaded") as volumes:
        return _shown(trained, volumes, overrides, [bad])


def edit(shown: FleetForecast, overrides: DataFrame, trained: Trained) -> FleetForecast:
    """The run that ``shown`` is, after more edits: the written volumes and fleet stay but for the edited cells."""
    changed = stage_table(volume.changed_cells(shown.volumes, overrides), "changed")
    volumes = shown.volumes.join(changed, ["ship_date", "entity"], "left_anti").unionByName(changed)
    volumes = stage_table(volumes, "volumes")
    fleet = stage_table(forecast.rescored(shown.fleet, changed, trained.score), "fleet")
    bad = volume.rejected_edits(overrides).select(F.lit("unreadable edit").alias("reason"), "n_rejected")
    lost = volume.unmatched_edits(shown.volumes, overrides).select(F.lit("edit without a cell"), "n_unmatched")
    features = volume.features(volumes)
    return FleetForecast(
        volumes,
        reshape.volume_pivot(volumes, filters.names(volumes, "entity")),
        fleet,
        forecast.matrix(features, fleet, trained.entities, trained.trucks),
        forecast.missing_entities(trained, features),
        stage_table(shown.rejected.unionAll(bad).unionAll(lost), "rejected"),
    )
