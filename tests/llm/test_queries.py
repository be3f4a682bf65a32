"""The training-data queries that SQL can express give the same rows as DuckDB."""

import pytest

from colloquy.llm import queries

from ..oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name])
