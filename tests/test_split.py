"""The exact split against sorting every group."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from haulcast.operators import split

SCHEMA = "grp string, k int, v double"


def plainly(rows, share, seed):
    """How often each (group, key) trains: rows of a group in the order of their hash."""
    groups = {}
    for g, k, v in rows:
        digest = hashlib.md5(f"{seed}|{'null' if g is None else g}|{'null' if k is None else k}".encode()).hexdigest()
        groups.setdefault(g, []).append((digest, k))
    out = Counter()
    for g, members in groups.items():
        for _, k in sorted(members, key=lambda m: m[0])[: math.floor(share * len(members))]:
            out[g, k] += 1
    return out


ROWS = [
    *[("a", i, 1.0) for i in range(500)],
    *[("b", i % 3, float(i % 2)) for i in range(100)],  # repeats of three keys
    *[("c", 1, 2.0)] * 10,  # equal rows
    ("d", 1, 1.0),
    ("e", None, None),
    ("e", None, 1.0),
    *[(None, i, None) for i in range(7)],
]


@pytest.mark.parametrize("places", [1, 4])
@pytest.mark.parametrize("share", [0.8, 0.5, 0.0, 1.0])
def test_equals_sorting(spark, monkeypatch, places, share):
    """With one digit a round as with four."""
    monkeypatch.setattr(split, "PLACES", places)
    out = split.exact_split(spark.createDataFrame(ROWS, SCHEMA), "grp", ["grp", "k"], share, 5).collect()
    assert Counter((r.grp, r.k, r.v) for r in out) == Counter(ROWS)
    assert Counter((r.grp, r.k) for r in out if r.is_train) == plainly(ROWS, share, 5)


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one, many = (sorted(map(repr, split.exact_split(df.repartition(n), "grp", ["grp", "k"], 0.8, 5).collect())) for n in (1, 7))
    assert one == many


def test_no_rows(spark):
    out = split.exact_split(spark.createDataFrame([], SCHEMA), "grp", ["k"], 0.8, 1)
    assert (out.columns, out.collect()) == (["grp", "k", "v", "is_train"], [])


def test_a_column_of_the_result_s_name_is_replaced(spark):
    df = spark.createDataFrame([("a", i, False) for i in range(10)], "grp string, k int, is_train boolean")
    assert sum(r.is_train for r in split.exact_split(df, "grp", ["k"], 0.8, 1).collect()) == 8
