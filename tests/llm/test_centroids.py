"""Clusters of whole-number vectors against a plain version and under hard rows."""

from __future__ import annotations

import hashlib
import math

import pytest
from haulcast.llm import centroids
from haulcast.llm.centroids import Plan
from pyspark.errors import PySparkException

SMALL = Plan(components=3, k=4, rounds=3)


def vectors(spark, rows):
    """Rows (vec_id, embedding) with further columns that clash with the operator's own."""
    full = [(i, e, 7, "c", 1.5) for i, e in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<double>, cluster int, x string, distance double")


def plainly(rows, plan):
    """The definition, vector by vector."""
    kept = []
    for i, e in rows:
        if e is not None and len(e) == plan.components and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(plan.scale * x) for x in e]))
    kept.sort(key=lambda r: (hashlib.sha256(f"{plan.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centers = [x for _, x in kept[: plan.k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centers))

    for _ in range(plan.rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centers = [[sum(v) // len(groups[n]) for v in zip(*groups[n])] if n in groups else c for n, c in enumerate(centers)]
    final = [(i, nearest(x)) for i, x in kept]
    inertia = sum(d for _, (d, _) in final)
    of = {n: sum(d for _, (d, m) in final if m == n) for n in range(len(centers))}
    return sorted(((i, n, d, of[n], inertia, centers[n]) for i, (d, n) in final), key=repr)


def found(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


HARD = [
    (1, [0.1, 0.2, 0.3]),
    (2, [0.1, 0.2, 0.3]),
    (2, [0.1, 0.2, 0.3]),
    (3, None),
    (4, []),
    (5, [0.1, 0.2]),
    (6, [0.1, None, 0.2]),
    (7, [float("nan"), 0.0, 0.0]),
    (8, [float("inf"), 0.0, 0.0]),
    (None, [5.0, -5.0, 0.001]),
    (None, [-0.001, 0.0, 0.0]),
    *[(10 + i, [math.sin(i), math.cos(3 * i), (i % 5) / 4]) for i in range(60)],
]


def test_hard_rows_equal_the_plain_version(spark):
    assert found(centroids.cluster_vectors(vectors(spark, HARD), SMALL)) == plainly(HARD, SMALL)


def test_partitions_and_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 7)
    df = vectors(spark, HARD).repartition(5)
    assert found(centroids.cluster_vectors(df, SMALL)) == plainly(HARD, SMALL)


def test_fewer_vectors_than_centroids(spark):
    rows = HARD[:4]
    assert found(centroids.cluster_vectors(vectors(spark, rows), SMALL)) == plainly(rows, SMALL)


def test_no_vectors(spark):
    out = centroids.cluster_vectors(vectors(spark, [(3, None)]), SMALL)
    assert out.collect() == []
    assert out.columns[:3] == ["vec_id", "cluster", "distance"]


def test_too_large_components_end_the_job(spark):
    with pytest.raises(PySparkException, match="too large"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e9, 0.0, 0.0])]), SMALL).collect()
