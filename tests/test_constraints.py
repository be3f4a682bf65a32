"""Constraints against faults that were planted one by one, and the gate."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators.constraints import BLOCKED, FAIL, PASS, Holds, Parity, Refers, Unique, audit, gate

IDS = {"a": "id", "b": "id"}


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, None, 2), (4, "y", None), (4, "y", 9), (None, "z", 9)], "id long, k string, ref long")
    return {"a": a, "b": spark.createDataFrame([(1, "p"), (2, "q"), (2, "q"), (3, None)], "id long, v string"), "none": a.limit(0)}


def told(report):
    return {r.constraint: (r.checked, r.failed, r.sample, r.status) for r in report.collect()}


def test_each_kind_counts_what_fails(tables):
    got = told(audit(tables, [
        Holds("null fails a test", "a", F.col("k") == "x"),
        Holds("among", "a", F.col("k") == "x", among=F.col("id") < 3),
        Unique("ids", "a", ("id",)),
        Unique("pairs", "a", ("id", "ref")),
        Refers("refs", "a", ("ref",), "b", ("id",)),
        Refers("chosen", "a", ("ref",), "b", ("id",), among=F.col("k") == "x", target_among=F.col("v") == "q"),
        Refers("two columns", "a", ("ref", "k"), "b", ("id", "v")),
        Parity("ids of both", "a", "id", "b", "id"),
    ], IDS))
    assert got == {
        "null fails a test": (6, 4, "3", FAIL), "among": (2, 0, None, PASS), "ids": (5, 2, "4", FAIL), "pairs": (4, 0, None, PASS),
        "refs": (5, 2, "4", FAIL), "chosen": (2, 2, "1", FAIL), "two columns": (4, 4, "1", FAIL), "ids of both": (4, 1, "4", FAIL),
    }


def test_empty_and_missing_tables(tables):
    checks = [Holds("h", "none", F.col("id") > 0), Unique("u", "none", ("id",)), Refers("r", "none", ("id",), "b", ("id",)), Refers("t", "b", ("id",), "none", ("id",)), Parity("p", "none", "id", "b", "id")]
    assert told(audit(tables, checks, {"none": "id", "b": "id"})) == {"h": (0, 0, None, PASS), "u": (0, 0, None, PASS), "r": (0, 0, None, PASS), "t": (4, 4, "1", FAIL), "p": (3, 3, "1", FAIL)}
    gone = audit({**tables, "b": None}, [Parity("p", "a", "id", "b", "id"), Refers("r", "a", ("ref",), "c", ("id",)), Unique("u", "a", ("id", "ref"))], IDS)
    assert told(gone) == {"p": (0, 0, None, BLOCKED), "r": (0, 0, None, BLOCKED), "u": (4, 0, None, PASS)}


def test_gate(tables):
    good, bad, soft = Unique("u", "a", ("id", "ref")), Unique("v", "a", ("id",)), Unique("w", "a", ("id",), hard=False)
    verdict = lambda *c: tuple(gate(audit(tables, list(c), IDS)).first())
    assert verdict(good, soft) == (2, 1, 1, 0, "PASSED")
    assert verdict(good, bad) == (2, 1, 1, 0, "FAILED")
    assert verdict(good, bad, Parity("p", "a", "id", "manifest", "id")) == (3, 1, 1, 1, "BLOCKED")
    assert verdict(good, Parity("p", "a", "id", "manifest", "id", hard=False)) == (2, 1, 0, 1, "PASSED")
    assert gate(audit(tables, [good], IDS).limit(0)).first().verdict == "BLOCKED"
    with pytest.raises(ValueError, match="must differ"):
        audit(tables, [good, good], IDS)


def test_tests_of_a_table_share_one_scan(tables):
    plan = audit({"a": tables["a"]}, [Holds(f"h{i}", "a", F.col("id") > i) for i in range(20)], IDS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
