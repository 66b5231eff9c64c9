from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from haulcast.functions import dates
from haulcast.models import scoring, store, training
from haulcast.models.candidates import CANDIDATES, Settings
from haulcast.operators import metrics
from haulcast.plans import forecast
from haulcast.staging import new_path, stage_table

TINY = Settings(trees=4, depth=8, boost_rounds=10, gbt_rounds=40)
TRUCKS = ["10T.BOX", "1T"]


@pytest.fixture(scope="module")
def base(spark):
    """Counts that follow the volume, with different loads per entity."""
    rows = []
    for i in range(150):
        for e, load in (("NORTH", 10.0), ("EAST COAST", 25.0)):
            vol = float((i * 37) % 200)
            rows.append((date(2021, 1, 1) + timedelta(days=i), e, vol, int(vol / load), int(vol / load / 2)))
    df = spark.createDataFrame(rows, "ship_date date, entity string, total_volume double, `10T.BOX` bigint, `1T` bigint")
    named = [F.col(f"`{c}`") for c in ["ship_date", "entity", *dates.FEATURES, *TRUCKS]]
    return stage_table(dates.with_calendar(df).select(named), "test")


@pytest.fixture(scope="module")
def trained(base):
    out = training.fit("region", base, TRUCKS, ["EAST COAST", "NORTH"], settings=TINY)
    out.choices = training.choose(out, base)
    return out


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_candidates_learn_the_load(base, trained):
    holdout = base.where(~metrics.is_training_day(F.col("ship_date")))
    maes = metrics.model_mae(trained.backtest(holdout)).collect()
    assert len(maes) == 2 * len(CANDIDATES)
    assert {(r.entity, r.model): r.mae for r in maes if r.mae >= 3.0} == {}


def test_choice_has_the_lowest_error(base, trained):
    holdout = base.where(~metrics.is_training_day(F.col("ship_date")))
    maes = metrics.model_mae(trained.backtest(holdout, rounded=False)).collect()
    for choice in trained.choices.collect():
        assert choice.mae == min(m.mae for m in maes if m.entity == choice.entity)


def test_same_seed_same_forecast(base, trained):
    again = training.fit("region", base, TRUCKS, ["EAST COAST", "NORTH"], ["random_forest", "adaboost"], TINY)
    mine = trained.backtest(base).where(F.col("model").isin("random_forest", "adaboost"))
    assert rows_of(again.backtest(base)) == rows_of(mine)


def test_score_gives_whole_trucks_once_per_key(base, trained):
    out = trained.score(base)
    assert dict(out.dtypes)["forecast"] == "bigint"
    assert out.count() == base.count() * len(TRUCKS)
    assert out.select("ship_date", "entity", "truck").distinct().count() == out.count()


def test_unlisted_entity_is_reported_and_its_days_stay(spark, base, trained):
    extra = spark.createDataFrame([(date(2022, 1, 1), "MOON", 5.0)], "ship_date date, entity string, total_volume double")
    feats = base.select("ship_date", "entity", *dates.FEATURES).unionByName(dates.with_calendar(extra))
    assert rows_of(forecast.missing_entities(trained, feats)) == [("MOON", 1)]
    matrix = forecast.forecast(trained, feats)
    assert matrix.columns[1:] == ["EAST COAST-10T.BOX", "EAST COAST-1T", "NORTH-10T.BOX", "NORTH-1T"]
    assert matrix.count() == 151
    assert tuple(matrix.where(F.col("ship_date") == F.lit(date(2022, 1, 1))).first())[1:] == (0, 0, 0, 0)


def test_saved_models_score_the_same(spark, base, trained):
    path = new_path(spark, "models")
    trained.save(path, spark)
    loaded = training.Trained.load(path, "region", spark)
    assert rows_of(loaded.backtest(base)) == rows_of(trained.backtest(base))
    assert rows_of(loaded.score(base)) == rows_of(trained.score(base))


def test_one_job_fits_a_thousand_entities_as_each_alone(spark, base):
    numbered = base.where(F.col("entity") == "NORTH").withColumn("entity", F.explode(F.sequence(F.lit(1), F.lit(1000))))
    many = numbered.withColumn("entity", F.col("entity").cast("string"))
    few = many.where(F.col("entity").isin("7", "700"))
    small = Settings(trees=2, depth=5, boost_rounds=2, gbt_rounds=2)
    names = [str(i) for i in range(1, 1001)]
    together = training.fit("region", many.where(F.month("ship_date") == 1), ["1T"], names, settings=small)
    assert together.nodes.select("entity").distinct().count() == 1000
    alone = training.fit("region", few.where(F.month("ship_date") == 1).repartition(1), ["1T"], ["7", "700"], settings=small)
    assert rows_of(together.nodes.where(F.col("entity").isin("7", "700"))) == rows_of(alone.nodes)


def test_adaboost_stops_at_a_perfect_tree(spark, base):
    out = training.fit("region", base.withColumn("1T", F.lit(3)), ["1T"], ["EAST COAST", "NORTH"], ["adaboost"], TINY)
    assert out.nodes.select("entity", "tree").distinct().count() == 2
    assert {r.forecast for r in out.backtest(base.withColumn("1T", F.lit(3))).collect()} == {3.0}


def hand_made(spark):
    """Two trees of a forest, three of an AdaBoost, one leaf alone; nodes as (tree, node, feature, cut, value, share)."""
    trees_of = {
        ("NORTH", "1T", "random_forest"): [
            (0, 1, 0, 10.0, 9.9, 0.5), (0, 2, None, None, 1.0, 0.5), (0, 3, 2, 6.0, 9.9, 0.5),
            (0, 6, None, None, 2.0, 0.5), (0, 7, None, None, 3.0, 0.5), (1, 1, None, None, 5.0, 0.5),
        ],
        ("NORTH", "1T", "adaboost"): [
            (0, 1, None, None, 9.0, 1.0), (1, 1, 3, 5.5, 0.0, 2.5), (1, 2, None, None, 1.0, 2.5), (1, 3, None, None, 4.0, 2.5),
            (2, 1, None, None, 2.0, 1.0),
        ],
        ("EAST COAST", "1T", "random_forest"): [(0, 1, None, None, 7.0, 1.0)],
    }
    rows = []
    for key, nodes in trees_of.items():
        for tree, node, feature, cut, value, share in nodes:
            inner = feature is not None
            rows.append((*key, tree, node, node.bit_length() - 1, feature, cut, 2 * node if inner else None, 2 * node + 1 if inner else None, value, share))
    return spark.createDataFrame(rows, scoring.NODES)


def test_forecasts_of_trees_scored_by_hand(spark):
    feats = [
        (date(2021, 3, 1), "NORTH", 10.0, 2021, 3, 1),  # at the cut: left
        (date(2021, 3, 6), "NORTH", 10.5, 2021, 3, 6),
        (date(2021, 7, 3), "NORTH", 99.0, 2021, 7, 6),
        (date(2021, 7, 3), "EAST COAST", 0.0, 2021, 7, 6),
        (date(2021, 7, 3), "MOON", 0.0, 2021, 7, 6),
    ]
    df = spark.createDataFrame(feats, "ship_date date, entity string, total_volume double, year int, month int, weekday int")
    got = scoring.forecasts(hand_made(spark), df, ["ship_date", "entity"], dates.FEATURES)
    assert {(r.ship_date, r.entity, r.candidate): r.raw for r in got.collect()} == {
        (date(2021, 3, 1), "NORTH", "random_forest"): 0.5 * 1 + 0.5 * 5,
        (date(2021, 3, 6), "NORTH", "random_forest"): 0.5 * 2 + 0.5 * 5,
        (date(2021, 7, 3), "NORTH", "random_forest"): 0.5 * 3 + 0.5 * 5,
        (date(2021, 3, 1), "NORTH", "adaboost"): 1.0,
        (date(2021, 3, 6), "NORTH", "adaboost"): 4.0,
        (date(2021, 7, 3), "NORTH", "adaboost"): 4.0,
        (date(2021, 7, 3), "EAST COAST", "random_forest"): 7.0,
    }


def test_forecasts_equal_walking_every_tree(base, trained):
    """All candidates on all days, against the node table walked row by row."""
    nodes = {}
    for r in trained.nodes.collect():
        nodes.setdefault((r.entity, r.truck, r.candidate), {}).setdefault(r.tree, {})[r.node] = r
    want = {}
    days = base.where(F.month("ship_date") == 2).collect()
    for d in days:
        numbers = [float(d[f]) for f in dates.FEATURES]
        for (entity, truck, candidate), forest in nodes.items():
            if entity != d.entity:
                continue
            met = []
            for _, tree in sorted(forest.items()):
                at = tree[1]
                while at.feature is not None:
                    at = tree[at.right if numbers[at.feature] > at.cut else at.left]
                met.append((at.value, at.share))
            if candidate == "adaboost":
                seen, half = 0.0, sum(s for _, s in met) / 2
                for value, share in sorted(met):
                    seen += share
                    if seen >= half:
                        break
                want[d.ship_date, entity, truck, candidate] = value
            else:
                want[d.ship_date, entity, truck, candidate] = sum(v * s for v, s in met)
    got = trained.backtest(base.where(F.month("ship_date") == 2), rounded=False).collect()
    assert {(r.ship_date, r.entity, r.truck, r.model): pytest.approx(r.forecast, abs=1e-9) for r in got} == want
    actual = {(d.ship_date, d.entity, t): d[t] for d in days for t in TRUCKS}
    assert all(r.actual == actual[r.ship_date, r.entity, r.truck] for r in got)


def test_plan_of_a_forecast_does_not_grow_with_models(base, trained):
    def joins(nodes):
        plan = scoring.forecasts(nodes, base, ["ship_date", "entity"], dates.FEATURES)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join ")

    one = trained.nodes.where((F.col("entity") == "NORTH") & (F.col("truck") == "1T"))
    assert joins(trained.nodes.where("level < 4")) == joins(one.where("level < 4")) <= 5


def test_partitions_do_not_matter(base, trained):
    again = training.fit("region", base.repartition(7, "total_volume"), TRUCKS, ["EAST COAST", "NORTH"], settings=TINY)
    assert rows_of(again.nodes) == rows_of(trained.nodes)


def test_accuracy_is_stored_and_a_broken_save_changes_nothing(spark, base, trained, monkeypatch):
    path = new_path(spark, "models")
    held = trained.backtest(base.where(~metrics.is_training_day(F.col("ship_date"))), rounded=False)
    trained.accuracy = stage_table(training.own_accuracy(trained, held), "accuracy")
    trained.save(path, spark)
    first = training.Trained.load(path, "region", spark)
    assert rows_of(first.accuracy.drop("date_time")) == rows_of(trained.accuracy.drop("date_time"))

    broken = training.Trained("region", ["9T"], ["X"], trained.nodes, trained.choices.select(F.raise_error(F.lit("cut off")).alias("entity")))
    with pytest.raises(Exception, match="cut off"):
        broken.save(path, spark)
    after = training.Trained.load(path, "region", spark)
    assert (after.trucks, after.entities) == (first.trucks, first.entities)
    assert rows_of(after.score(base)) == rows_of(first.score(base))

    training.Trained("region", ["9T"], ["X"], trained.nodes).save(path, spark)
    newest = training.Trained.load(path, "region", spark)
    assert (newest.trucks, newest.choices, newest.accuracy) == (["9T"], None, None)


def test_nothing_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.current(spark, f"file://{tmp_path}/none")


def test_weighted_median(spark):
    met = "array(named_struct('tree', 0, 'value', 9D, 'share', {}), named_struct('tree', 1, 'value', 1D, 'share', 1D), named_struct('tree', 2, 'value', 5D, 'share', 1D))"
    out = spark.range(1).select(
        scoring.weighted_median(F.expr(met.format("1D"))).alias("even"),
        scoring.weighted_median(F.expr(met.format("5D"))).alias("heavy"),
    ).first()
    assert (out.even, out.heavy) == (5.0, 9.0)


def test_entity_without_held_out_days_takes_the_first_candidate(spark, base, trained):
    one_day = base.where(metrics.is_training_day(F.col("ship_date"))).limit(1)
    choice = training.choose(trained, one_day).first()
    assert (choice.model, choice.mae) == ("random_forest", None)


def test_listed_entity_without_history_keeps_zero_columns(spark, base):
    out = training.fit("region", base, ["1T"], ["ATLANTIS", "EAST COAST", "NORTH"], ["random_forest"], TINY)
    out.choices = training.choose(out, base)
    feats = base.select("ship_date", "entity", *dates.FEATURES)
    matrix = forecast.forecast(out, feats)
    assert matrix.columns[1:] == ["ATLANTIS-1T", "EAST COAST-1T", "NORTH-1T"]
    assert matrix.where(F.col("ATLANTIS-1T") != 0).count() == 0
    moved = feats.withColumn("entity", F.lit("ATLANTIS"))
    assert rows_of(forecast.missing_entities(out, moved)) == [("ATLANTIS", 300)]


def test_deep_trees_need_no_join_per_level(spark):
    """A tree of 30 levels: one join in the plan, nothing written on the way, and nulls and NaN where Spark's comparison sends them."""
    deep = [("NORTH", "1T", "random_forest", 0, 2**k, k, 0, 30.0 - k, 2 ** (k + 1), 2 ** (k + 1) + 1, 9.9, 1.0) for k in range(30)]
    leaves = [("NORTH", "1T", "random_forest", 0, 2 ** (k + 1) + 1, k + 1, None, None, None, None, 30.0 - k, 1.0) for k in range(30)]
    last = ("NORTH", "1T", "random_forest", 0, 2**30, 30, None, None, None, None, 0.0, 1.0)
    nodes = spark.createDataFrame([*deep, *leaves, last], scoring.NODES)
    volumes = [99.0, 30.0, 17.5, 0.5, None, float("nan")]
    rows = [(date(2021, 3, 1 + i), "NORTH", v, 2021, 3, 1) for i, v in enumerate(volumes)]
    df = spark.createDataFrame(rows, "ship_date date, entity string, total_volume double, year int, month int, weekday int")
    got = scoring.forecasts(nodes, df, ["ship_date", "entity"], dates.FEATURES)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "scored-" not in plan
    assert [r.raw for r in got.orderBy("ship_date").collect()] == [30.0, 29.0, 17.0, 0.0, 0.0, 30.0]
