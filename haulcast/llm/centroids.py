"""Operator 13: k-means on whole numbers, distances from scalar lookup tables.

Components become integers ``floor(scale * x)``. Vectors are packed once, in
blocks of some thousand: a block lists, for each dimension, the integers that
occur in it, and holds each vector as the places of its components in those
lists. In every round a task tabulates the squared difference of each occurring
integer to each centroid, per dimension; the distances of a whole block are
then gathers from these tables, added up. All arithmetic is on integers, so the
result is exact and the same on any partitioning.

Defined cases: a vector that is null, of another length, or with a null or
non-finite component (also after scaling) is left out; a null id is an id like
any other, but starts as a centroid only if no other ids are left; rows that
repeat an id are vectors of their own, and the smaller components win a tie
between equal ids; with fewer vectors than ``k`` each starts a centroid; no
vectors give no rows. A component of 2^27 or more after scaling ends the job
with an error, since its squared distance may not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.tables import col
from haulcast.staging import stage_table

#: Vectors of a block; places in its lists fit 16 bits.
BLOCK = 4096
LARGEST = 1 << 27

PACKED = "ids array<bigint>, counts binary, values binary, places binary"
ASSIGNED = "vec_id bigint, cluster int, distance bigint"


@dataclass(frozen=True)
class Plan:
    """Parameters of a clustering."""

    components: int = 64
    k: int = 40
    rounds: int = 5
    scale: int = 256
    seed: int = 2


def whole_numbers(x: Column, plan: Plan) -> Column:
    """The integer components, or null for a vector that is left out."""
    scaled = F.transform(x, lambda v: F.lit(float(plan.scale)) * v.cast("double"))
    fine = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    small = F.forall(scaled, lambda v: F.abs(v) < F.lit(float(LARGEST)))
    numbers = F.transform(scaled, lambda v: F.floor(v).cast("int"))
    too_large = F.raise_error(F.lit("a component is too large for distances that fit a long")).cast("array<int>")
    return F.when((F.size(x) == plan.components) & fine, F.when(small, numbers).otherwise(too_large))


def _pack(n_dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK:
                rows = pa.Table.from_batches(waiting).combine_chunks()
                done = rows.num_rows - rows.num_rows % BLOCK
                for at in range(0, done, BLOCK):
                    yield _block(rows.slice(at, BLOCK), n_dims)
                waiting = rows.slice(done).to_batches()
        if sum(b.num_rows for b in waiting):
            yield _block(pa.Table.from_batches(waiting), n_dims)

    return run


def _block(rows: pa.Table, n_dims: int) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    matrix = rows["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dims)
    values, places = [], []
    for d in range(n_dims):
        occurring, place = np.unique(matrix[:, d], return_inverse=True)
        values.append(occurring.astype(np.int32))
        places.append(place.astype(np.uint16))
    counts = np.array([len(v) for v in values], np.int32)
    ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows["vec_id"].chunk(0))
    parts = [counts.tobytes(), np.concatenate(values).tobytes(), np.concatenate(places).tobytes()]
    arrays = [ids, *[pa.array([p], pa.binary()) for p in parts]]
    return pa.RecordBatch.from_arrays(arrays, ["ids", "counts", "values", "places"])


@dataclass
class Block:
    ids: pa.Array
    values: list[np.ndarray]
    places: np.ndarray

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each vector's nearest centroid, the smaller one at a tie, and the squared distance."""
        distance = np.zeros((len(self.ids), len(centroids)), np.int64)
        for d, occurring in enumerate(self.values):
            table = (occurring[:, None].astype(np.int64) - centroids[None, :, d]) ** 2
            distance += table[self.places[d]]
        cluster = distance.argmin(axis=1)
        return cluster, distance[np.arange(len(cluster)), cluster]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int32)
            values = np.frombuffer(batch.column("values")[i].as_py(), np.int32)
            places = np.frombuffer(batch.column("places")[i].as_py(), np.uint16)
            yield Block(ids, np.split(values, np.cumsum(counts)[:-1]), places.reshape(len(counts), len(ids)))


def _sums(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and cluster: vectors, summed distance, and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n_dims = centroids.shape
        n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, n_dims), np.int64)
        for block in _blocks(batches):
            cluster, distance = block.nearest(centroids)
            order = np.argsort(cluster, kind="stable")
            present, first = np.unique(cluster[order], return_index=True)
            n += np.bincount(cluster, minlength=k)
            inertia[present] += np.add.reduceat(distance[order], first)
            for d, occurring in enumerate(block.values):
                component = occurring[block.places[d]].astype(np.int64)
                sums[present, d] += np.add.reduceat(component[order], first)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(some, pa.int32()),
                pa.array(n[some], pa.int64()),
                pa.array(inertia[some], pa.int64()),
                pa.array(sums[some].tolist(), pa.list_(pa.int64())),
            ],
            ["cluster", "n", "inertia", "sums"],
        )

    return run


def _totals(blocks: DataFrame, centroids: np.ndarray) -> list:
    """One row per non-empty cluster, at most ``k``."""
    parts = blocks.mapInArrow(_sums(centroids), "cluster int, n bigint, inertia bigint, sums array<bigint>")
    components = F.array(*[F.sum(F.col("sums")[d]) for d in range(centroids.shape[1])])
    return (
        parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), components.alias("sums"))
    ).collect()


def _assign(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            cluster, distance = block.nearest(centroids)
            arrays = [block.ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(df: DataFrame, plan: Plan = Plan(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that counts.

    The driver holds the ``k`` centroids and one row of sums per cluster, whatever the number of vectors.
    """
    spark = df.sparkSession
    kept = df.select(col(df, key).cast("bigint").alias("vec_id"), whole_numbers(col(df, vector), plan).alias("x"))
    kept = kept.where(F.col("x").isNotNull())
    drawn = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(drawn.alias("drawn"), "x").orderBy(F.col("drawn").asc_nulls_last(), "x").limit(plan.k).collect()
    empty = "cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    if not first:
        return spark.createDataFrame([], f"{ASSIGNED}, {empty}")
    centroids = np.array([row.x for row in first], np.int64)
    blocks = stage_table(kept.mapInArrow(_pack(plan.components), PACKED), "vectors")
    for _ in range(plan.rounds):
        moved = centroids.copy()
        for row in _totals(blocks, centroids):
            moved[row.cluster] = [total // row.n for total in row.sums]
        centroids = moved
    final = {row.cluster: row.inertia for row in _totals(blocks, centroids)}
    rows = [(c, final.get(c, 0), sum(final.values()), centroids[c].tolist()) for c in range(len(centroids))]
    clusters = spark.createDataFrame(rows, f"cluster int, {empty}")  # k rows
    return blocks.mapInArrow(_assign(centroids), ASSIGNED).join(F.broadcast(clusters), "cluster")


def text_digest(numbers: Column) -> Column:
    """Lowercase hex of the SHA-256 of decimal numbers joined by commas."""
    return F.sha2(F.concat_ws(",", numbers.cast("array<string>")), 256)
