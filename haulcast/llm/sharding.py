"""Operator 7: weighted rendezvous hashing of stable record keys.

Each record draws one hash per shard from its key and goes to the shard of the
highest score ``-weight / ln(u)``. A further shard draws a hash of its own and
leaves all other scores alone, so it only takes records and none moves between
the old shards; a shard's share follows its weight.

Defined cases: a null key is a key like any other (the empty hash input
"null"), so such rows share a shard; rows with equal keys share a shard;
a null text has no bytes; weights are positive; an empty table gives no rows.
Everything is column expressions, the only shuffle numbers rows inside a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.tables import col

#: Parts of a shard that are numbered side by side; the parts' counts are the only table sent around.
SLOT_PARTS = 512


def unit(key: Column, *salt: object) -> Column:
    """A number of [0, 1) drawn from the key: 52 bits of MD5."""
    parts = [F.coalesce(key.cast("string"), F.lit("null")), *[F.lit(str(s)) for s in salt]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def write_shards(df: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    df.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the highest score; equal scores go to the smaller number."""
    scores = [
        F.struct((F.lit(-float(w)) / F.ln(unit(key, "shard", i) + F.lit(2.0**-53))).alias("s"), F.lit(-i).alias("i"))
        for i, w in enumerate(weights)
    ]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["i"]).cast("int")


def slot_part(key: Column, *spread: Column) -> Column:
    """The part of its shard that numbers a row: drawn from key and ``spread``, so that a hot key meets many tasks."""
    drawn = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in (key, *spread)])
    return F.floor(unit(drawn, "slot") * SLOT_PARTS).cast("int")


def shard_records(
    df: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] = (1.0,) * 8,
    grown: Sequence[float] | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (gapless from 0 inside the shard) and ``grown_shard`` under the weights ``grown``.

    ``spread_by`` names further columns that tell rows of one key apart. Slots
    follow the part, then the key. Columns of the three names in ``df`` are replaced.
    """
    grown = tuple(weights) + (1.0,) if grown is None else grown
    k = col(df, key)
    placed = df.withColumns(
        {
            "shard": shard_of(k, weights),
            "grown_shard": shard_of(k, grown),
            "slot": slot_part(k, *[col(df, c) for c in spread_by]),
        }
    )
    # Rows of a shard are numbered in SLOT_PARTS parts; each part starts after the rows of the parts before it.
    sizes = placed.groupBy("shard", F.col("slot").alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "slot").orderBy(k)
    numbered = placed.withColumn("__row", F.row_number().over(within)).withColumnRenamed("slot", "__part")
    return (
        numbered.join(F.broadcast(starts), ["shard", "__part"])
        .withColumn("slot", (F.col("__first") + F.col("__row") - 1).cast("long"))
        .select(*[col(df, c) for c in df.columns if c not in ("shard", "slot", "grown_shard")], "shard", "slot", "grown_shard")
    )
