"""Every query with SQL gives the same rows as DuckDB, and the others run."""

import os
import subprocess
import sys

import pytest

from colloquy import queries

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["rank", "canonical_name", "event_count", "distinct_session_count", "session_share"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_a_session():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True, timeout=120)
