"""Every core query against its SQL."""

import pytest

from tests.oracle import DATA, connection, spark_rows, sql_rows
from vellum.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connection()


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(con, SQL[name])
