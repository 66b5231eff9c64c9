from __future__ import annotations

import math

import pytest
from haulcast.llm import mixing, quality, sharding
from pyspark.sql import functions as F


def test_shards_follow_weights_and_growth_moves_rows_to_the_new_shard_only(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("clash"))
    out = sharding.shard_records(df, weights=(1.0, 2.0, 1.0), grown=(1.0, 2.0, 1.0, 1.0)).collect()
    share = [sum(r.shard == s for r in out) / 20000 for s in range(3)]
    assert share == pytest.approx([0.25, 0.5, 0.25], abs=0.02)
    moved = [r for r in out if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {3}
    assert len(moved) / 20000 == pytest.approx(0.2, abs=0.02)
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_shards_of_hard_rows(docs, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (2, None)]
    out = sharding.shard_records(docs(rows), spread_by=["text"]).collect()
    assert len(out) == 6
    assert len({r.shard for r in out if r.doc_id == 1}) == len({r.shard for r in out if r.doc_id is None}) == 1
    sharding.write_shards(sharding.shard_records(docs(rows)), f"{tmp_path}/out")
    assert docs([]).sparkSession.read.parquet(f"{tmp_path}/out").count() == 6
    assert sharding.shard_records(docs([])).collect() == []


def test_poisson_steps_are_the_distribution(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 40.0), (None, 900.0)], "source string, rate double")
    for r in mixing.poisson_steps(rates).collect():
        at = int(r.rate)
        exact = math.fsum(math.exp(k * math.log(r.rate) - r.rate - math.lgamma(k + 1)) for k in range(at + 1))
        assert r.steps[at] == pytest.approx(exact, abs=1e-10)
        assert r.steps == sorted(r.steps) and r.steps[-1] == pytest.approx(1, abs=1e-10)


def test_sources_reach_their_shares(docs):
    rows = [(i, f"t{i}", "big" if i % 10 else "small") for i in range(4000)] + [(9000 + i, None, None) for i in range(200)]
    out = mixing.mix_sources(docs(rows), {"big": 1.0, "small": 2.0, None: 1.0}, rows_out=8000).collect()
    n = {s: sum(r.source == s for r in out) for s in ("big", "small", None)}
    assert n == {"small": pytest.approx(4000, rel=0.1), "big": pytest.approx(2000, rel=0.15), None: pytest.approx(2000, rel=0.15)}
    again = mixing.mix_sources(docs(rows).repartition(7), {"big": 1.0, "small": 2.0, None: 1.0}, rows_out=8000).collect()
    assert sorted(r.mix_order for r in out) == sorted(r.mix_order for r in again)
    copies: dict[int, set[int]] = {}
    for r in out:
        copies.setdefault(r.doc_id, set()).add(r.copy)
    assert all(c == set(range(len(c))) for c in copies.values())


def test_mixing_edges(docs):
    assert mixing.mix_sources(docs([])).collect() == []
    rows = [(1, "a", "s"), (1, "a", "s"), (None, "b", "s"), (2, "c", "other")]
    out = mixing.mix_sources(docs(rows), {"s": 1.0}, rows_out=60)
    assert {r.source for r in out.collect()} == {"s"}
    assert mixing.mix_sources(docs(rows), {"none": 1.0}).count() == 0
    assert set(docs(rows).columns) <= set(out.columns)


def test_a_host_of_failures_is_refused(docs):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "too short" if i < 45 else good, "bad") for i in range(50)]
    rows += [(100 + i, good, f"h{i % 8}") for i in range(400)] + [(900, "short", "tiny"), (901, None, None), (902, good, None)]
    out = {r.doc_id: r for r in quality.judge(quality.measure(docs(rows))).collect()}
    assert all(out[i].host_failed and not out[i].kept for i in range(50))
    assert not out[49].base_failed
    assert all(out[100 + i].kept for i in range(400))
    # One short document says little about its host.
    assert out[900].base_failed and not out[900].host_failed
    assert not out[901].kept


def test_rates_are_shrunk_towards_the_mean(docs):
    rows = [(i, "x", f"h{i % 7}") if i % 3 else (i, "w " * 30 + str(i), f"h{i % 7}") for i in range(210)] + [(999, "x", "one")]
    rates = {r.host: r.rate for r in quality.host_rates(quality.measure(docs(rows))).where("rule = 'short'").collect()}
    assert rates["h1"] < rates["one"] < 1.0
