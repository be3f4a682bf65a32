"""Upserts, batches and incremental work lists over tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


#: Bounds between the ranges in which keys are numbered.
RANGES = 500


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key isn't in new, and new: one anti-join."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(old.columns))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, batch: keys in order, so many a batch.

    Keys are dealt into ranges between bounds that a sample gives, and numbered within their range; only the ranges'
    counts are put together. A key's range follows from the bounds alone, however often the plan is run.
    """
    keys = rows.select(key).distinct()
    bounds = sorted(r[0] for r in keys.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(RANGES).collect())
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    parts = keys.withColumn("p", F.when(F.col(key).isNull(), -1).otherwise(place))
    counts = parts.groupBy("p").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n")).select("p", "before")
    nth = F.row_number().over(Window.partitionBy("p").orderBy(key))
    numbered = parts.withColumn("nth", nth).join(F.broadcast(before), "p")  # a row a range
    return numbered.select(key, F.expr(f"(before + nth - 1) div {size}").alias("batch"))


def work_list(current: DataFrame, state: DataFrame, key: str, mode: str = "changed") -> DataFrame:
    """key, action for content-addressed ingest: REUSE if content and contract hash are those of a success, else WORK.

    Modes: changed takes what isn't reusable, full takes all, audit takes nothing.
    """
    done = state.where("status = 'SUCCESS'").select(key, "content_hash", "contract_hash").distinct().withColumn("known", F.lit(True))
    rows = current.join(done, [key, "content_hash", "contract_hash"], "left")
    action = {"changed": F.when(F.col("known"), "REUSE").otherwise("WORK"), "full": F.lit("WORK"), "audit": F.when(F.col("known"), "REUSE").otherwise("MISSING")}[mode]
    return rows.select(key, action.alias("action"))
