"""Every query against DuckDB on the small tables."""

from __future__ import annotations

import __spark_entry__ as entry_points
import oracle
import pytest
from haulcast.catalog.oracles import all_oracles
from haulcast.catalog.queries import all_queries

QUERIES = all_queries()
SQL = all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(SQL) <= set(entry_points.oracle_sql())
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, sf_dir, con, name):
    assert oracle.differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


#: Forecasts, choices and errors of fitted models: no SQL. What they must equal is in test_models.py and test_trees.py.
OF_MODELS = {
    "fit_rf", "fit_adaboost", "fit_extratrees", "fit_gbt", "fit_rf_2", "train_all", "train_sides", "accuracy_table",
    "fleet_region", "fleet_customer", "fleet_history_tail",
}


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(SQL) == OF_MODELS


def test_entry(spark, sf_dir):
    assert entry_points.entry(spark).count() > 0
