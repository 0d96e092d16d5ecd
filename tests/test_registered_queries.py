"""Every registered query against its SQL, on the smallest data folder."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# these find nothing in 200 documents
MAY_BE_EMPTY = {"J2_new_only"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    problem = compare.difference(QUERIES[name](spark, FOLDER), con, SQL[name])
    assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()
