"""All queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_audit as audit, queries_core as core, queries_more as more, queries_search as search

QUERIES = {**core.Q, **search.Q, **more.Q, **audit.Q}
ORACLE_SQL = {**core.SQL, **search.SQL, **more.SQL, **audit.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["m3_recurring_misconceptions"](spark, d)
