"""What the training-data operators share: tables, the shared folder, folds, labelled samples."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes in an Arrow batch that goes to Python: texts may be long, so a batch holds few; one longer text goes alone.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20

_WRITTEN: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset in local mode, one is made and set.

    On a cluster no machine's own folder is shared, so there an unset one is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; what is written there goes at the driver's exit."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system holds it."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: its folder goes with the cluster's job
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    return written(df, tag)[0]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """A table as written to the shared folder, and where."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The written result of make; what it wrote on its way, which nothing reads any more, is removed."""
    mark = len(_WRITTEN)
    out = materialize(make(), tag)
    for spark, path in _WRITTEN[mark:-1]:
        remove(spark, path)
    del _WRITTEN[mark:-1]
    return out


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch holds, as texts may be very long; the session keeps these settings, as plans are run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(labels: DataFrame, target: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """At most `bound` labelled ids outside the held-out fold, chosen by hash: columns doc_id, y.

    Repeated ids count once (the largest label); null ids and null labels take no part.
    """
    rows = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def let(value: Column, body) -> Column:
    """body of a value that is computed once: inside a lambda, an outer expression is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column, block: int = 256) -> Column:
    """Sums of what stands before each of an array of longs; in blocks, so long arrays take linear time."""

    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def whole(all_sizes: Column) -> Column:
        count = F.ceil(F.size(all_sizes) / F.lit(block)).cast("int")
        parts = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.slice(all_sizes, (i - 1) * block + 1, F.lit(block))))
        return let(parts, inner)

    def inner(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        starts = sums(totals, F.lit(0).cast("long"))
        return F.flatten(F.filter(F.zip_with(parts, starts, lambda p, s: F.when(p.isNotNull(), F.slice(sums(p, s), F.lit(1), F.size(p)))), lambda x: x.isNotNull()))

    return F.coalesce(let(sizes, whole), F.array().cast("array<bigint>"))
