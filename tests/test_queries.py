"""Every registered query against its SQL counterpart, on whole tables."""

import pytest
from compare import connect, kinds, spark_table, sql_table

import __spark_entry__ as job

ORACLES = job.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    columns, rows = spark_table(job.queries()[name](spark, sf_dir))
    sql_columns, sql_rows = sql_table(con, ORACLES[name])
    assert columns == sql_columns
    assert rows == sql_rows
    assert kinds(rows, len(columns)) == kinds(sql_rows, len(columns))
    assert rows, "a query that returns nothing proves nothing"


def test_every_query_has_an_oracle():
    from brandsieve.plans.catalog import QUERIES

    assert set(QUERIES) <= set(ORACLES)


def test_entry(spark):
    assert job.entry(spark).columns == ["lang", "is_gibberish", "n_docs", "n_chars"]
