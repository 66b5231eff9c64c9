from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from test_near_duplicates import brute

ORDER = ["quality_rules", "near_duplicates", "decontaminate", "mix_sources", "shard"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def test_order_and_columns(stages, spark, sf_dir):
    assert list(stages) == ORDER
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    for name in ORDER[:-1]:
        assert stages[name][1].columns == columns


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_duplicates_keep_one_of_each_group(stages):
    before, after = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    groups = brute(rows, 5, 80)
    assert sorted(ids(after)) == sorted(i for i, (_, root) in groups.items() if i == root)


def test_no_benchmark_item_is_left(stages, spark, sf_dir):
    before, after = stages["decontaminate"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in before.collect()}
    leaked = {i for i, t in texts.items() if any(x in t for x in items)}
    kept = set(ids(after))
    assert leaked and not leaked & kept
    # Besides whole items only near-whole ones may go.
    assert len(set(texts) - kept - leaked) <= 2


def test_every_kept_row_has_one_shard_and_slot(stages):
    before, after = stages["shard"]
    assert sorted(ids(before)) == sorted(ids(after))
    for shard in range(8):
        slots = sorted(r.slot for r in after.where(f"shard = {shard}").collect())
        assert slots == list(range(len(slots)))


def test_run_gives_the_last_stage(stages, spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    columns = out.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, stages["shard"][1].select(columns).collect()), key=repr)


PROSE = "the quick brown fox number {} jumps over a lazy dog while {} other animals look on and wonder why it does so at all times of day"
HARD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (None, PROSE.format("null", "some"), None),
    (None, PROSE.format("null", "some"), None),
    (5, PROSE.format("five", "seven"), "a"),
    (5, PROSE.format("five", "seven"), "a"),
    (6, PROSE.format("five", "seven"), "b"),
    (7, PROSE.format("seven", "many"), "b"),
    (8, " ".join(f"word{i}" for i in range(60_000)), "c"),
    (9, "same words again " * 200, "c"),
]
CLASHING = (
    "n_words short repeats symbols dup_lines n_lines base_failed host_failed kept n_shingles component_id "
    "contaminated leaked_item leaked_share copy rate mix_order h words root"
).split()


@pytest.fixture
def hard(spark):
    rows = [(i, t, "en", s, len(t or ""), *[f"{c}{n}" for c in CLASHING]) for n, (i, t, s) in enumerate(HARD)]
    types = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {types}")


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", ORDER[:-1])
def test_columns_of_the_caller_pass_unchanged(spark, sf_dir, hard, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, hard, sf_dir)
    assert out.columns == hard.columns
    assert set(rows_of(out)) <= set(rows_of(hard))


def test_hard_rows_by_stage(spark, sf_dir, hard):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, hard, sf_dir)
    assert Counter(ids(kept)) == {None: 2, 5: 2, 6: 1, 7: 1, 8: 1}
    single = stages["near_duplicates"](spark, hard, sf_dir)
    assert Counter(ids(single)) == {1: 1, 2: 1, 3: 1, None: 2, 5: 2, 7: 1, 8: 1, 9: 1}
    assert rows_of(stages["decontaminate"](spark, hard, sf_dir)) == rows_of(hard)
    mixed = Counter(ids(stages["mix_sources"](spark, hard, sf_dir)))
    assert set(mixed) <= {i for i, _, _ in HARD} and mixed[5] % 2 == 0 and mixed[None] % 2 == 0
    placed = stages["shard"](spark, hard, sf_dir).collect()
    assert len(placed) == len(HARD)
    assert len({r.shard for r in placed if r.doc_id is None}) == len({r.shard for r in placed if r.doc_id == 5}) == 1


@pytest.mark.parametrize("name", ORDER)
def test_empty_table(spark, sf_dir, hard, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, hard.where("false"), sf_dir)
    assert out.columns[: len(hard.columns)] == hard.columns and out.count() == 0
