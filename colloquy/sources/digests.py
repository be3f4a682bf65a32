"""Digests of row sets that are summed where rows lie: no order, no sort, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: 64-bit lanes of a SHA-256.
LANES = 4


def row_digest(*columns: Column) -> Column:
    """SHA-256 of columns as one JSON text: null, empty and missing differ, and so do numbers and texts."""
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def sums(digest: Column | str = "digest") -> list[Column]:
    """Aggregates of a group of row digests: sums of their four 64-bit lanes. Rows that repeat count as often as they are there."""
    lane = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    return [F.sum(lane(i)).alias(f"lane{i}") for i in range(LANES)]


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """by, n, digest: SHA-256 of the lanes' sums and of the number of rows, for each group of rows (column digest).

    Two sets of rows that differ have the same digest by chance only: unlike sums of short hashes, changes can't cancel.
    """
    lanes = [f"lane{i}" for i in range(LANES)]
    grouped = rows.groupBy(*by).agg(F.count("*").alias("n"), *sums())
    return grouped.select(*by, "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[F.col(c).cast("string") for c in lanes]), 256).alias("digest"))
