"""Every query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from catalogue.queries import all_queries as queries
from catalogue.sql import all_sql as oracle_sql
from tools.check_against_sql import compare, open_duckdb

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(FOLDER)


def test_every_query_has_sql():
    assert sorted(queries()) == sorted(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_result(spark, duck, name):
    result = queries()[name](spark, FOLDER)
    rows = [row.asDict() for row in result.collect()]
    relation = duck.sql(oracle_sql()[name])
    schema = {c: str(t).lower() for c, t in zip(relation.columns, relation.types)}
    expected = [dict(zip(relation.columns, row)) for row in relation.fetchall()]
    assert compare(rows, dict(result.dtypes), expected, schema) == []
