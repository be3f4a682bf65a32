"""Versions of a table: digests, what is written, what is read and what a comparison gives."""

import glob

import pytest
from pyspark.sql import functions as F

from colloquy.sources import merkle, store

SCHEMA = "id long, text string, x double, days array<int>"
ROWS = [(i, f"t{i}", i / 7, [i, None]) for i in range(400)] + [(None, "no key", None, None), (3, "t3", 3 / 7, [3, None]), (5, None, float("nan"), [])]


@pytest.fixture
def table(spark):
    return merkle.MerkleTable(spark, store.scratch(spark), ["id"], levels=2)


def told(df):
    return sorted((str(r.id), r.status, r.n_before, r.n_after) for r in df.collect())


def test_root_is_of_content_alone(spark, table):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    root = table.write("a", rows)
    assert table.write("b", rows.repartition(7).select("x", "days", "id", "text")) == root
    assert table.write("c", rows.where("id <> 17 or id is null")) != root
    assert table.write("d", rows.unionByName(rows.where("id = 17"))) != root  # a row that repeats counts twice
    assert table.write("e", rows.withColumn("text", F.when(F.col("id") == 17, F.lit("")).otherwise(F.col("text")))) != root
    assert table.write("f", rows.withColumnRenamed("x", "y")) != root
    assert sorted(map(str, table.rows("a").collect())) == sorted(map(str, rows.collect()))


def test_changes_equal_plain_comparison_and_cost_what_differs(spark, table):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    table.write("a", rows)
    new = [r for r in ROWS if r[0] not in (10, 20)] + [(1000, "new", None, None), (3, "t3", 3 / 7, [3, None])]
    new = [(r[0], "other", *r[2:]) if r[0] in (30, None) else r for r in new]
    table.write("b", spark.createDataFrame(new, SCHEMA), parent="a")
    want = [("10", "REMOVED", 1, 0), ("1000", "ADDED", 0, 1), ("20", "REMOVED", 1, 0), ("3", "CHANGED", 2, 3), ("30", "CHANGED", 1, 1), ("None", "CHANGED", 1, 1)]
    assert told(table.changes("a", "b")) == want
    assert told(table.changes("b", "a")) == sorted((k, {"ADDED": "REMOVED", "REMOVED": "ADDED"}.get(s, s), b, a) for k, s, a, b in want)
    assert table.changes("a", "a").count() == 0
    # six keys, so at most six of 256 buckets are written and read again
    assert len(table.differing("a", "b")) <= 6
    written = {r.version: r.written for r in table.manifest().collect()}
    assert written["b"] <= 6 < 100 < written["a"]
    plan = table.changes("a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(bucket" in plan or "PushedFilters: [IsNotNull(bucket), In(bucket" in plan, plan
    assert sorted(str(r.id) for r in table.rows("b").collect()) == sorted(str(r[0]) for r in new)


def test_one_key_holds_most_rows(spark, table):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"), (F.col("id") % 5).alias("v"))
    table.write("a", rows)
    table.write("b", rows.where("not (id = 7 and v = 4)"), parent="a")
    assert told(table.changes("a", "b")) == [("7", "CHANGED", 1001 if 7 % 3 else 1000, rows.where("id = 7 and v <> 4").count())]


def test_empty_versions(spark, table):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    table.write("none", rows.limit(0))
    table.write("a", rows, parent="none")
    table.write("gone", rows.limit(0), parent="a")
    assert table.changes("none", "gone").count() == 0 and table.rows("gone").count() == 0
    assert {r.status for r in table.changes("none", "a").collect()} == {"ADDED"}
    assert {r.status for r in table.changes("a", "gone").collect()} == {"REMOVED"}


def test_a_source_that_changes_while_it_is_written_fails(spark, table):
    unsteady = spark.range(50).withColumn("v", F.expr("uuid()"))
    unsteady = unsteady.withColumn("v", F.udf(lambda v: __import__("uuid").uuid4().hex).asNondeterministic()("v"))
    with pytest.raises(ValueError, match="content differs"):
        table.write("a", unsteady)
    with pytest.raises(ValueError, match="isn't ready"):
        table.rows("a")
    table.write("a", spark.range(50))  # the failed one is no obstacle
    with pytest.raises(ValueError, match="there already"):
        table.write("a", spark.range(50))


def test_what_storage_alters_is_found(spark, table):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    table.write("a", rows)
    assert table.wrong("a").count() == 0
    bucket = table._placed(rows.where("id = 42")).first().bucket
    (folder,) = glob.glob(f"{table.path.removeprefix('file://')}/data/*")
    held = spark.read.parquet(f"file://{folder}")
    lost = spark.createDataFrame(held.where("row.id <> 42 or row.id is null").collect(), held.schema)
    lost.write.mode("overwrite").parquet(f"file://{folder}")
    assert [r.bucket for r in table.wrong("a").collect()] == [bucket]
