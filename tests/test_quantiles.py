"""Exact quantiles against the built-in ones, and any table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators.quantiles import ordered, quantiles


def test_order_of_bits_is_that_of_numbers():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, 200), r.normal(0, 1e300, 50), r.normal(0, 1e-310, 50), [0.0, -0.0, np.inf, -np.inf, 1.0, np.nextafter(1, 2)]])
    key = ordered(x)
    assert (np.argsort(key, kind="stable") == np.argsort(x, kind="stable")).all() and ordered(np.array([0.0]))[0] == ordered(np.array([-0.0]))[0]
    assert ordered(np.array([-np.nan])).item() == ordered(np.array([np.nan])).item() > ordered(np.array([np.inf])).item()


def test_quantiles_equal_the_built_in_ones(spark):
    r = random.Random(2)
    rows = [("hot", r.choice([r.gauss(0, 1e6), 3.5, -r.random() * 1e-9])) for _ in range(3_000)]  # one group has most rows, and repeats
    rows += [(g, r.gauss(0, 1)) for g in ("a", "b", None) for _ in range(r.choice([1, 2, 7, 100]))] + [("a", None), ("empty", None), ("one", 4.0), ("inf", math.inf), ("inf", -math.inf), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {x.g: [x[f"q{i}"] for i in range(5)] for x in quantiles(df, ["g"], "x", shares).collect()}
    want = {x.g: x.q for x in df.where("x is not null").groupBy("g").agg(F.percentile("x", F.lit(shares)).alias("q")).collect()}
    assert got.keys() == want.keys() and "empty" not in got
    assert all(got[g] == pytest.approx(want[g], rel=1e-12, nan_ok=True) for g in want)


def test_two_keys_whole_tables_and_nothing(spark):
    df = spark.createDataFrame([(i % 2, None if i % 3 else "k", i, 0) for i in range(30)], "a int, b string, x int, q0 int")
    got = {(r.a, r.b): r.q0 for r in quantiles(df, ["a", "b"], "x", [0.5]).collect()}
    assert got == {(r.a, r.b): r.m for r in df.groupBy("a", "b").agg(F.percentile("x", 0.5).alias("m")).collect()}
    assert quantiles(df, [], "x", [0.5]).first().q0 == 14.5
    assert quantiles(df.limit(0), ["a"], "x", [0.5]).collect() == []
    for bad in ([], [1.5]):
        with pytest.raises(ValueError):
            quantiles(df, [], "x", bad)
