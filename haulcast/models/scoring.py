"""Forecasts from a node table: each model meets the rows of its entity and walks its trees.

A node table has one row per node of every tree of every model: (entity, truck,
candidate, tree, node, level, feature, cut, left, right, value, share). One shuffle
brings the nodes of a model and the rows of its entity together, whatever the depth
and the number of trees. What a task holds at a time is one model, bounded by its training
days and trees as in the fit, and the rows of one entity, a series of days; the rows
are walked a tree at a time, so rows times trees never exist as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from haulcast.functions.numbers import quoted
from haulcast.models.candidates import BY_MEDIAN

NODES = (
    "entity string, truck string, candidate string, tree int, node bigint, level int, "
    "feature int, cut double, left bigint, right bigint, value double, share double"
)
MODEL = ["entity", "truck", "candidate"]
#: Models that one task scores, at some tenths of a second each.
MODELS_PER_TASK = 64


def _x(i: int) -> str:
    """Name of the column of feature ``i``."""
    return f"x{i}"


def forecasts(nodes: DataFrame, rows: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep..., truck, candidate, raw) for every row of ``rows`` and every model of its entity.

    ``keep`` must name the entity and tell rows of an entity apart. Entities without models give no rows.
    """
    numbers = [F.col(quoted(f)).cast("double").alias(_x(i)) for i, f in enumerate(features)]
    given = rows.select(*[F.col(quoted(k)) for k in keep], *numbers)
    # Aliased, so that the two sides of the cogroup do not share columns.
    models = nodes.where(F.col("level") == 0).select(*[F.col(c).alias(c) for c in MODEL]).distinct()
    # A model is little data and much work: their number, not their bytes, says how many tasks there are.
    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-models.count() // MODELS_PER_TASK))
    asked = given.join(models, "entity").repartition(parts, *MODEL).groupBy(*MODEL)
    walked = nodes.select(*MODEL, "tree", "node", "feature", "cut", "left", "right", "value", "share")
    walked = walked.repartition(parts, *MODEL).groupBy(*MODEL)
    out = [given.schema[k] for k in keep]
    out += [StructField("truck", StringType()), StructField("candidate", StringType()), StructField("raw", DoubleType())]
    return asked.cogroup(walked).applyInArrow(_score(list(keep), len(features)), StructType(out))


def _score(keep: list[str], n_features: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        columns = [_numbers(rows[_x(i)]) for i in range(n_features)]
        met, shares = walk(nodes, np.stack(columns, axis=1)) if len(rows) else (np.empty((0, 0)), np.empty(0))
        by_median = len(rows) > 0 and rows["candidate"][0].as_py() in BY_MEDIAN
        raw = median_of(met, shares) if by_median else total_of(met, shares)
        out = rows.select([*keep, "truck", "candidate"])
        return out.append_column("raw", pa.array(raw, pa.float64(), mask=np.isnan(raw)))

    return run


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles ordered as Spark orders them: NaN above all numbers; a null goes left at every cut."""
    null, out = column.is_null().to_numpy(), column.fill_null(0.0).to_numpy()
    return np.where(null, -np.inf, np.where(np.isnan(out), np.inf, out))


def walk(nodes: pa.Table, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value that each tree gives each line of ``x``, a line per tree in their order, and the trees' shares.

    NaN where a tree lacks the node that a line goes to.
    """
    nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
    tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    feature, cut = nodes["feature"].fill_null(-1).to_numpy(), nodes["cut"].fill_null(0.0).to_numpy()
    left, right = (nodes[c].fill_null(-1).to_numpy() for c in ("left", "right"))
    value, share = nodes["value"].to_numpy(), nodes["share"].to_numpy()
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    met = np.empty((len(starts), len(x)))
    for i, (start, end) in enumerate(zip(starts, np.r_[starts[1:], len(tree)])):
        own = slice(start, end)
        # A last place stands for nodes that the table lacks.
        features, values = np.r_[feature[own], -1], np.r_[value[own], np.nan]
        children = np.stack([_places(node[own], left[own]), _places(node[own], right[own])])
        at = np.zeros(len(x), np.int64)
        going = np.flatnonzero(features[at] >= 0)
        while len(going):
            here = at[going]
            at[going] = children[(x[going, features[here]] > cut[own][here]).astype(np.int64), here]
            going = going[features[at[going]] >= 0]
        met[i] = values[at]
    return met, share[starts]


def _places(node: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in ``node``, which ascends, the wanted ones stand; past its end if they do not."""
    place = np.minimum(np.searchsorted(node, wanted), len(node) - 1)
    return np.where(node[place] == wanted, place, len(node))


def total_of(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Sum of values times shares, added up in the order of the trees."""
    out = np.zeros(met.shape[1])
    for values, share in zip(met, shares.tolist()):
        out = out + values * share
    return out


def median_of(met: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Smallest value at which half of the total share is reached."""
    weights = np.repeat(shares[:, None], met.shape[1], axis=1)
    order = np.lexsort((weights, met), axis=0)
    values, seen = np.take_along_axis(met, order, 0), np.cumsum(np.take_along_axis(weights, order, 0), axis=0)
    first = np.argmax(seen >= 0.5 * seen[-1], axis=0)
    return np.take_along_axis(values, first[None, :], 0)[0]


def weighted_median(met: str) -> Column:
    """Smallest value at which half of the total share is reached."""
    pairs = F.array_sort(F.transform(met, lambda t: F.struct(t["value"].alias("v"), t["share"].alias("w"))))
    half = 0.5 * F.aggregate(pairs, F.lit(0.0), lambda out, p: out + p["w"])
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("median"))

    def step(state: Column, pair: Column) -> Column:
        seen = state["seen"] + pair["w"]
        median = F.when(state["median"].isNull() & (seen >= half), pair["v"]).otherwise(state["median"])
        return F.struct(seen.alias("seen"), median.alias("median"))

    return F.aggregate(pairs, start, step, lambda state: state["median"])
