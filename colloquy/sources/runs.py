"""Work done batch by batch that survives a crash: a log of attempts, outputs that count once they are committed.

A batch is bound to the digest of its rows and to a contract (a version of what is done to them). Its log entries are small
files, each put in place whole: STARTED before an attempt, then SUCCESS or FAILED. The output of an attempt lies in a folder
of its own and is read only if a SUCCESS names it, so what a dead writer leaves is never seen and never reused; it is
removed when the batch is taken up again, and that attempt counts. A batch whose rows have changed has another digest
and is new work; one that hasn't changed is reused, whatever its number is now.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .digests import row_digest, summed
from .store import _fs, write_text

ENTRY = "source_hash string, contract string, batch long, attempt int, status string, rows long, folder string, reason string, at long"


def stable_batches(key: Column, count: int) -> Column:
    """A batch number from a key's hash: rows that come or go change their own batch only."""
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("long")


@dataclass(frozen=True)
class Outcome:
    """What a run did: batches reused, done and failed."""

    reused: list[int]
    done: list[int]
    failed: list[int]


class BatchRun:
    """Batches of rows under a path, worked on until each has one committed output."""

    def __init__(self, spark: SparkSession, path: str, contract: str) -> None:
        self.spark, self.path, self.contract = spark, path.rstrip("/"), contract

    def log(self) -> DataFrame:
        """All entries of this contract, of all attempts."""
        fs, at = _fs(self.spark, f"{self.path}/log")
        if not fs.exists(at):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("mode", "FAILFAST").json(f"{self.path}/log").where(F.col("contract") == self.contract)

    def _enter(self, **entry: object) -> None:
        entry |= {"contract": self.contract, "at": time.time_ns()}
        write_text(self.spark, f"{self.path}/log/{entry['source_hash'][:16]}-{entry['attempt']:04d}-{entry['status']}-{uuid.uuid4().hex}.json", json.dumps(entry, ensure_ascii=False) + "\n")

    def states(self, batched: DataFrame) -> DataFrame:
        """batch, source_hash, n, status, attempts, folder of each batch of rows (a column batch): SUCCESS, FAILED, CRASHED or NEW.

        Null batch numbers are a batch of their own. Rows without any column but batch can't be told apart and count only.
        """
        content = [F.col(c) for c in batched.columns if c != "batch"]
        now = summed(batched.select("batch", row_digest(*content).alias("digest")), "batch").select("batch", "n", F.concat_ws("-", F.coalesce(F.col("batch").cast("string"), F.lit("null")), "digest").alias("source_hash"))
        ended = F.max(F.when(F.col("status") == "SUCCESS", F.struct("attempt", "folder")))
        last = F.max(F.struct("attempt", (F.col("status") != "STARTED").alias("end"), "status"))
        known = self.log().groupBy("source_hash").agg(ended.alias("good"), last.alias("last"), F.max("attempt").alias("attempts"))
        status = F.when(F.col("good").isNotNull(), "SUCCESS").when(F.col("last").isNull(), "NEW").when(F.col("last.end"), F.col("last.status")).otherwise("CRASHED")
        return now.join(known, "source_hash", "left").select("batch", "source_hash", "n", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "good.folder")

    def run(self, batched: DataFrame, work: Callable[[DataFrame], DataFrame], attempts: int = 3) -> Outcome:
        """Work on each batch of rows that has no committed output; one that has failed or crashed `attempts` times is left alone.

        work gets a batch's rows, without the column batch. An exception of a batch is recorded and the next batch begins.
        """
        states = self.states(batched).collect()  # a row for each batch
        reused, done, failed = [], [], []
        for s in sorted(states, key=lambda s: (s.batch is not None, s.batch)):
            if s.status == "SUCCESS":
                reused.append(s.batch)
                continue
            if s.attempts >= attempts:
                failed.append(s.batch)
                continue
            mine = {"source_hash": s.source_hash, "batch": s.batch, "attempt": s.attempts + 1}
            folder = f"{self.path}/out/{uuid.uuid4().hex}"
            self._remove(s.source_hash)
            self._enter(**mine, status="STARTED", folder=folder)
            try:
                rows = self._write(work(batched.where(F.col("batch").eqNullSafe(F.lit(s.batch))).drop("batch")), folder)
            except Exception as e:
                self._enter(**mine, status="FAILED", reason=str(e).splitlines()[0][:500] if str(e) else type(e).__name__)
                failed.append(s.batch)
                continue
            self._enter(**mine, status="SUCCESS", rows=rows, folder=folder)
            done.append(s.batch)
        return Outcome(reused, done, failed)

    def _write(self, out: DataFrame, folder: str) -> int:
        out.write.parquet(folder)
        return self.spark.read.schema(out.schema).parquet(folder).count()

    def _remove(self, source_hash: str) -> None:
        """Take away what attempts at a batch left that didn't end well."""
        for r in self.log().where((F.col("source_hash") == source_hash) & (F.col("status") == "STARTED")).select("folder").collect():
            fs, at = _fs(self.spark, r.folder)
            fs.delete(at, True)

    def results(self, batched: DataFrame, schema: str) -> DataFrame:
        """The committed outputs of these rows' batches, with their batch; fails if one has none."""
        states = self.states(batched).select("batch", "status", "folder").collect()
        missing = sorted(str(s.batch) for s in states if s.status != "SUCCESS")
        if missing:
            raise ValueError(f"no output of batch {', '.join(missing[:5])}")
        out = self.spark.createDataFrame([], f"batch long, {schema}")
        for s in states:
            out = out.unionByName(self.spark.read.schema(schema).parquet(s.folder).withColumn("batch", F.lit(s.batch).cast("long")))
        return out
