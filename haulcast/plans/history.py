"""History side: resolved shipments to the pruned rows and the base table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.functions.numbers import quoted, round_all_doubles
from haulcast.functions.text import short_name, truck_short_name
from haulcast.operators import abt, filters, topk
from haulcast.staging import staged


@dataclass(frozen=True)
class Side:
    """One forecasting side: what an entity is and how far history is pruned."""

    name: str
    entity_column: str
    segments: tuple[str, ...]
    top_trucks: int
    top_entities: int | None = None
    synonyms: Mapping[str, str] = field(default_factory=dict)


def customer_side(segments, synonyms: Mapping[str, str] | None = None) -> Side:
    """Per customer: four truck types, nine customers by volume."""
    return Side("customer", "dest_name", tuple(segments), 4, 9, dict(synonyms or {}))


def region_side(segments) -> Side:
    """Per region: two truck types, every region."""
    return Side("region", "dest_zone2", tuple(segments), 2)


def clean(resolved: DataFrame) -> DataFrame:
    """Doubles to two places, start time to a day."""
    return round_all_doubles(resolved).withColumn("ship_date", F.to_date("start_ts"))


def entity_key(name: Column, side: Side) -> Column:
    """The name under which history, uploads and edits of a side meet: upper case, spelling variants replaced."""
    upper = {variant.upper(): kept.upper() for variant, kept in side.synonyms.items()}
    return filters.canonical(F.upper(name), upper)


def side_rows(resolved: DataFrame, side: Side) -> DataFrame:
    """The side's segments with canonical entity names, before any pruning."""
    entity = entity_key(F.col(quoted(side.entity_column)), side)
    return filters.in_segments(resolved, side.segments).select(
        F.to_date("start_ts").alias("ship_date"),
        entity.alias("entity"),
        "equipment_gid",
        "shipment_xid",
        "total_volume",
    )


def profile(rows: DataFrame) -> DataFrame:
    """Rows and volume per entity and equipment: the only input of both rankings.

    It is a few entities by a few truck types, whatever the size of the history.
    """
    return rows.groupBy("entity", "equipment_gid").agg(
        F.count("*").alias("n_rows"), F.sum("total_volume").alias("total_volume")
    )


def top_trucks(profiled: DataFrame, k: int) -> DataFrame:
    counted = profiled.where(F.col("equipment_gid").isNotNull()).groupBy("equipment_gid").agg(
        F.sum("n_rows").alias("n_rows")
    )
    return topk.top_k(counted, "equipment_gid", "n_rows", k)


def volume_by_entity(profiled: DataFrame) -> DataFrame:
    return profiled.where(F.col("entity").isNotNull()).groupBy("entity").agg(
        F.coalesce(F.sum("total_volume"), F.lit(0.0)).alias("total_volume")
    )


def top_entities(profiled: DataFrame, trucks: DataFrame, k: int) -> DataFrame:
    """Largest entities by volume, counting only rows the truck pruning keeps."""
    kept = topk.keep_top(profiled, "equipment_gid", trucks)
    return topk.top_k(volume_by_entity(kept), "entity", "total_volume", k)


@dataclass(frozen=True)
class SideHistory:
    """One side's rows with the names its pruning keeps.

    Both lists come from a ranking cut at k, so they hold at most ``top_trucks``
    and ``top_entities`` names. As literals they prune at the scan, where a
    join against the rankings would first read every row.
    """

    side: Side
    rows: DataFrame
    kept_trucks: list[str]
    kept_entities: list[str] | None

    def truck_names(self) -> list[str]:
        """Short names; two identifiers with one short name count together."""
        return sorted({short_name(gid) for gid in self.kept_trucks})

    def prepared(self) -> DataFrame:
        """Rows of the kept trucks and entities, and rows that have none."""
        gid, entity = F.col("equipment_gid"), F.col("entity")
        out = self.rows.where(gid.isin(self.kept_trucks) | gid.isNull())
        if self.kept_entities is not None:
            out = out.where(entity.isin(self.kept_entities) | entity.isNull())
        return out.withColumn("truck", truck_short_name(gid))

    def base_table(self, trucks: list[str] | None = None) -> DataFrame:
        """Analytics base table; ``trucks`` fixes its columns, else the kept ones are used."""
        return abt.base_table(self.prepared(), self.truck_names() if trucks is None else trucks)

    def long_counts(self) -> DataFrame:
        """Base table with one row per (day, entity, kept truck), zero counts included."""
        names = self.truck_names()
        return abt.long_counts(self.base_table(names), names)


def open_side(resolved: DataFrame, side: Side) -> SideHistory:
    """Rank trucks and entities in one pass over the history.

    With two rankings the profile is written to the shared folder and both read
    that small table; the history itself is read here and for the base table.
    """
    rows = side_rows(resolved, side)
    if side.top_entities is None:
        counted = topk.frequencies(rows, "equipment_gid")
        trucks = topk.top_k(counted, "equipment_gid", "n_rows", side.top_trucks)
        return SideHistory(side, rows, _kept_trucks(trucks), None)
    with staged(profile(rows), f"profile-{side.name}") as profiled:
        trucks = top_trucks(profiled, side.top_trucks)
        entities = top_entities(profiled, trucks, side.top_entities)
        return SideHistory(side, rows, _kept_trucks(trucks), topk.top_names(entities, "entity"))


def _kept_trucks(top: DataFrame) -> list[str]:
    return topk.top_names(top, "equipment_gid")
