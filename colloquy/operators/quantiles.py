"""Exact quantiles of groups of any size: selection by counts of digits, in four passes.

A double's bits, turned so that they sort as the numbers do, are read as four digits of 16 bits. Each pass counts the
next digit of those rows that share the digits found so far and so learns which digit holds the wanted rank. A group
never needs more than 65,536 counts at once, summed before they move, whatever the number of its values is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.store import scratch
from .retrieval import small

DIGIT = 16


def ordered(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles: NaN last, both zeros equal."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ (bits >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by and q0, q1, ...: for each group the interpolated quantile of each share (0 to 1) of a column of numbers.

    Null values don't count, a group without any has no row, null is a group like any other, NaN is the largest value.
    """
    if not shares or not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares must be within 0 and 1")
    spark = rows.sparkSession
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("one"))
    base = rows.select(group.alias("g"), F.col(value).cast("double").alias("value")).where("value is not null")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ordered(b.column(1).to_numpy()))], ["g", "value", "key"])

    path = scratch(spark)
    schema = f"g {base.schema['g'].dataType.simpleString()}, value double, key long"
    base.mapInArrow(turn, schema).write.parquet(path)
    keys = spark.read.schema(schema).parquet(path)
    n = keys.groupBy("g").agg(F.count("*").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)])).alias("w")
    place = n.select("g", "n", wanted).select("g", "w.i", (F.col("w.share") * (F.col("n") - 1)).alias("place"))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("high"), f("place").cast("long").alias("rank")) for k, f in enumerate((F.floor, F.ceil))])).alias("e")
    targets = place.select("g", "i", "place", ends).select("g", "i", "place", "e.high", "e.rank", F.lit(0).cast("long").alias("prefix"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        known = F.lit(0).cast("long") if shift == 64 - DIGIT else F.shiftright("key", shift + DIGIT)
        own = keys.withColumn("prefix", known)
        if shift < 64 - DIGIT:
            own = own.join(small(targets.select("g", "prefix").distinct()), ["g", "prefix"], "left_semi")
        counts = own.groupBy("g", "prefix", F.shiftright("key", shift).alias("next")).agg(F.count("*").alias("n"), F.min("value").alias("value"))
        below = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("next")) - F.col("n")
        found = targets.join(counts.withColumn("below", below), ["g", "prefix"]).where("below <= rank and rank < below + n")
        step = scratch(spark)
        found.select("g", "i", "place", "high", (F.col("rank") - F.col("below")).alias("rank"), F.col("next").alias("prefix"), "value").write.parquet(step)
        kept = spark.read.parquet(step)
        targets = kept.drop("value")
    at = lambda i, high: F.max(F.when((F.col("i") == i) & (F.col("high") == high), F.col("value")))
    frac = lambda i: F.max(F.when(F.col("i") == i, F.col("place") - F.floor("place")))
    told = kept.groupBy("g").agg(*[c for i in range(len(shares)) for c in (at(i, 0).alias(f"l{i}"), at(i, 1).alias(f"h{i}"), frac(i).alias(f"f{i}"))])
    between = [F.when(F.col(f"l{i}") == F.col(f"h{i}"), F.col(f"l{i}")).otherwise((1 - F.col(f"f{i}")) * F.col(f"l{i}") + F.col(f"f{i}") * F.col(f"h{i}")).alias(f"q{i}") for i in range(len(shares))]
    return told.select(*[F.col(f"g.{c}").alias(c) for c in by], *between)
