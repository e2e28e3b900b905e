"""Every query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from convfeat.catalog import QUERIES, SQL
from tests.oracle import connect, difference, spark_table, sql_table

SF = "/root/testdata/sf0.001"
SQL_FREE = {"fit_score", "train_predict", "stream_scores"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_other_query_has_sql():
    assert set(QUERIES) - set(SQL) == SQL_FREE
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = spark_table(QUERIES[name](spark, SF))
    assert difference(got, sql_table(duck, SQL[name])) is None


def test_entry(spark):
    assert entry(spark).count() == 4
