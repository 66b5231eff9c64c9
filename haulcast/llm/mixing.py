"""Operator 10: mix sources to target weights by Poisson replication.

A source with ``n`` rows and target share ``w`` of ``rows_out`` rows repeats each
of its rows ``rate = rows_out * w / n`` times on average. Each row's count is
the inverse of the Poisson distribution of that rate at a number in [0, 1)
drawn from the row's key and the seed: the same key always gets the same count,
whatever the partitioning. Rows are exploded by their counts and then sorted by
a hash of key, copy and seed over the whole table: a global shuffle that a lost
executor cannot change.

Defined cases: a null source is a source of its own; a null key draws as the
text "null"; rows with equal key and source get equal counts; sources without a
target (or with weight 0) get no rows; an empty table gives no rows. Counts are
taken over all rows; there is no cap on a rate: the steps of the distribution
run to ``rate + 12 * sqrt(rate) + 40``, beyond which less than 2**-53 remains.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.sharding import unit
from haulcast.llm.tables import col
from haulcast.staging import stage_table

COPY = "copy"
RATE = "rate"
ORDER = "mix_order"


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds ``steps``: P(X <= k) for k = 0, 1, ... of a Poisson X of mean ``rate``, one row per source."""
    last = F.ceil(F.col(RATE) + 12 * F.sqrt(RATE) + 40).cast("int")
    ks = rates.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    up_to = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(up_to)
    point = F.when(F.col(RATE) > 0, F.exp(F.col("k") * F.ln(RATE) - F.col(RATE) - F.col("lf"))).otherwise(
        F.when(F.col("k") == 0, 1.0).otherwise(0.0)
    )
    below = ks.withColumn("lf", log_factorial).withColumn("point", point).withColumn("p", F.sum("point").over(up_to))
    return below.groupBy("source", RATE).agg(F.array_sort(F.collect_list(F.struct("k", "p")))["p"].alias("steps"))


def target_rates(
    df: DataFrame, source: str, weights: Mapping[str | None, float] | None, rows_out: int | None = None
) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its share; without ``weights`` all shares are equal."""
    counts = df.groupBy(col(df, source).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.lit(1.0))
    else:
        known = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        counts = counts.withColumn("w", F.coalesce(*known, F.lit(0.0)))
    # Written, so that the planner knows the size of what comes of it and broadcasts only what is small.
    counts = stage_table(counts.where("w > 0"), "mix-counts")
    total = counts.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    all_n = float(rows_out if rows_out is not None else total["n"] or 0)
    rate = F.lit(all_n) * F.col("w") / F.lit(float(total["w"] or 1.0)) / F.col("n")
    return counts.select("source", rate.alias(RATE))


def mix_sources(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    key: str = "doc_id",
    source: str = "source",
    rows_out: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Rows of ``df`` repeated to the target shares, in random order, with ``copy`` (from 0) and ``rate``.

    Columns of ``df`` with those names, or ``mix_order``, are replaced.
    """
    steps = stage_table(poisson_steps(target_rates(df, source, weights, rows_out)), "mix-steps").select(
        F.col("source").alias("__source"), F.col(RATE).alias("__rate"), "steps"
    )
    kept = df.drop(COPY, RATE, ORDER)
    k = col(kept, key)
    joined = kept.withColumn("__u", unit(k, seed, "mix")).join(steps, col(kept, source).eqNullSafe(F.col("__source")))
    times = F.size(F.filter("steps", lambda p: F.col("__u") >= p))
    copies = joined.withColumn("__times", times).drop("steps").where("__times > 0")
    copies = copies.withColumn(COPY, F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    order = F.md5(F.concat_ws("|", F.coalesce(k.cast("string"), F.lit("null")), F.col(COPY).cast("string"), F.lit(str(seed))))
    copies = copies.select(*[col(kept, c) for c in kept.columns], COPY, F.col("__rate").alias(RATE), order.alias(ORDER))
    # The hash is uniform: dealing rows out by it and sorting inside each part is a shuffle of the whole.
    return copies.repartition(ORDER).sortWithinPartitions(ORDER)
