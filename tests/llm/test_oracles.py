"""Queries with SQL on tables of hard rows: nulls, ties, repeats, blanks, long texts."""

from __future__ import annotations

import duckdb
import oracle
import pytest
from haulcast.llm.oracles import all_oracles
from haulcast.llm.queries import all_queries

HARD = [
    (1, "", "a"),
    (2, None, "a"),
    (3, " \n\t ", None),
    (4, "same words " * 40, None),
    (5, "same words " * 40, "b"),
    (6, "line one here\nline one here\n\nline two", "b"),
    (7, "a#b $c <d> |e| " + "x" * 3000, "c"),
    (8, "été ÉTÉ naïve space   \v\f end " * 9, "c"),
    (9, " ".join(f"w{i % 23}" for i in range(5000)), "c"),
    (10, " ".join(f"w{i % 23}" for i in range(4990)), "d"),
    (11, "one two three four five six seven eight nine ten " * 3, "d"),
]

HARD_VECTORS = [
    (1, [0.25] * 64),
    (2, None),
    (3, [0.5] * 63),
    (4, [None] * 64),
    (5, [float("nan")] * 64),
    *[(10 + i, [((i * 37 + d * 11) % 29) / 29 - 0.5 for d in range(64)]) for i in range(90)],
]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def hard(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hard"))
    df = docs([(i, t, s) for i, t, s in HARD])
    df.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    vectors(spark, HARD_VECTORS).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_hard_rows(spark, hard, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{hard}/{table}.parquet/*.parquet'")
    assert oracle.differences(all_queries()[name](spark, hard), con, all_oracles()[name]) == []


@pytest.mark.parametrize("name", sorted(set(all_queries()) - {"op2_benchmark_leaks", "op4_page_texts"}))
def test_empty_documents(spark, docs, tmp_path, name):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    vectors(spark, []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all_queries()[name](spark, str(tmp_path)).count() == 0
