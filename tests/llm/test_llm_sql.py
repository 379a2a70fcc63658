"""Queries whose results SQL can express, on the smallest tables."""

import pytest

from tallyworks.llm.queries import QUERIES
from tallyworks.llm.sql import SQL
from tools.check_against_sql import compare, open_duckdb

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, name):
    result = QUERIES[name](spark, FOLDER)
    rows = [row.asDict() for row in result.collect()]
    relation = open_duckdb(FOLDER).sql(SQL[name])
    schema = {c: str(t).lower() for c, t in zip(relation.columns, relation.types)}
    expected = [dict(zip(relation.columns, row)) for row in relation.fetchall()]
    assert compare(rows, dict(result.dtypes), expected, schema) == []
