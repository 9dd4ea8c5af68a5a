"""Queries that SQL can express equal it; every query reads its whole table."""

import pytest

from checks.compare import normal_rows
from ebbtide.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    result = connection.execute(SQL[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    assert normal_rows(names, result.fetchall()) == normal_rows(df.columns, df.collect())


def test_operators_are_registered_in_order():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14)) and set(SQL) <= set(QUERIES)
