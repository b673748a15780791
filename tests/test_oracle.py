"""Every query with SQL gives the same columns and values; the others give rows."""

import pytest

import oracle
from riskweave.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, con, name):
    columns, rows = oracle.spark_rows(QUERIES[name](spark, folder))
    sql_columns, sql_rows = oracle.sql_rows(con, SQL[name])
    assert columns == sql_columns
    assert rows == sql_rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
