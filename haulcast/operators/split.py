"""Seeded split of exact size, per group.

Of each group's rows the floor(share * n) with the smallest hash of their keys train. The
hash at which a group is cut is found digit by digit: a round counts the rows of
each group by the next digits of their hash, below the part that is settled. A
group is never sorted or brought to one task; a window sees at most one row per
digit. Only rows that share their whole hash with the cut, repeats of one key,
are told apart by their other columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.functions.numbers import quoted
from haulcast.staging import stage_table

#: Hexadecimal places that one round settles, of the 32 of an MD5.
PLACES, ALL_PLACES = 4, 32


def row_hash(seed: int, keys: Sequence[str]) -> Column:
    """MD5 of seed and keys; a null key counts as the text ``null``."""
    texts = [F.coalesce(F.col(quoted(k)).cast("string"), F.lit("null")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))


def exact_split(df: DataFrame, group: str, keys: Sequence[str], share: float, seed: int) -> DataFrame:
    """``df`` with ``is_train``: true in exactly floor(share * n) rows of each of its groups; a null group is a group."""
    columns = [c for c in df.columns if c != "is_train"]
    hashed = df.withColumns({"__hash": row_hash(seed, keys), "__group": F.col(quoted(group)).cast("string")})
    cuts = _cuts(hashed, share)
    at = hashed.join(cuts, F.col("__group").eqNullSafe(F.col("__of")), "left")
    start = F.left("__hash", F.length("__cut"))
    # Below the cut or at a cut that takes all its rows: training. At a cut that takes some: see _shared_out.
    below, equal = start < F.col("__cut"), start == F.col("__cut")
    partly = equal & (F.col("__take") < F.col("__held"))
    clear = at.where(~partly).select(*[F.col(quoted(c)) for c in columns], (below | (equal & (F.col("__take") > 0))).alias("is_train"))
    return clear.unionByName(_shared_out(at.where(partly), columns))


def _cuts(hashed: DataFrame, share: float) -> DataFrame:
    """(__of, __cut, __take, __held): per group the digits of its cut, how many rows there train, how many there are."""
    sizes = hashed.groupBy(F.col("__group").alias("__of")).agg(F.count("*").alias("__held"))
    # A cut of no digits holds the whole group.
    cuts = sizes.select("__of", F.lit("").alias("__cut"), F.floor(F.col("__held") * F.lit(share)).alias("__take"), "__held")
    cuts = stage_table(cuts, "cuts")
    for places in range(PLACES, ALL_PLACES + 1, PLACES):
        open_cuts = cuts.where((F.col("__take") > 0) & (F.col("__take") < F.col("__held")))
        if open_cuts.isEmpty():
            break
        inside = hashed.join(open_cuts, F.col("__group").eqNullSafe(F.col("__of"))).where(F.startswith("__hash", "__cut"))
        digits = F.substring("__hash", 1, places).alias("__next")
        counted = inside.groupBy("__of", "__take", digits).agg(F.count("*").alias("n"))
        so_far = Window.partitionBy("__of").orderBy("__next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = counted.withColumn("upto", F.sum("n").over(so_far))
        # The digits at which the wanted number is reached.
        reached = (F.col("upto") >= F.col("__take")) & (F.col("upto") - F.col("n") < F.col("__take"))
        found = counted.where(reached).select(
            "__of", F.col("__next").alias("__cut"), (F.col("__take") - F.col("upto") + F.col("n")).alias("__take"), F.col("n").alias("__held")
        )
        settled = cuts.where((F.col("__take") <= 0) | (F.col("__take") >= F.col("__held")))
        cuts = stage_table(settled.unionByName(found), "cuts")
    return cuts


def _shared_out(ties: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one hash: the first ``__take`` train, in the order of their other columns. Equal rows are counted, not listed."""
    own = [F.col(quoted(c)).alias(c) for c in columns]
    counted = ties.groupBy("__of", "__hash", "__take", *own).agg(F.count("*").alias("__n"))
    order = [F.to_json(F.struct(*own))]
    so_far = Window.partitionBy("__of", "__hash").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = counted.withColumn("__upto", F.sum("__n").over(so_far))
    places = F.sequence(F.col("__upto") - F.col("__n") + 1, F.col("__upto"))
    return numbered.withColumn("__place", F.explode(places)).select(*own, (F.col("__place") <= F.col("__take")).alias("is_train"))
