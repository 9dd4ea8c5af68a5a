"""Every registered query equals its SQL; the entry points hold together."""

import pytest

import __spark_entry__
from checks.compare import difference
from checks.oracle import SQL
from checks.queries import QUERIES
from tests.conftest import plan_of

NO_SQL = {"logistic_regression_runs", "tree_model_runs", "forest_importances", "tree_contribution_reasons", "search_trials", "six_variant_metrics"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    assert difference(QUERIES[name](spark, sf_dir), connection, name) is None


def test_only_fitted_models_have_no_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(__spark_entry__.queries()) >= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) >= set(SQL)


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["scored_customers", "contribution_reasons_text", "engineered_features", "record_violations"])
def test_row_work_stays_in_the_jvm(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
