"""Versions of a table as a content tree: buckets by key, a digest each, and a tree of digests above them.

A row's bucket follows from its key, a bucket's digest from its rows (see digests), whatever their order or
place. A new version writes only buckets whose digest differs from that of the version before it; the others stay
where they are. Two versions are compared from the root down, and only buckets that differ are read: files are in
order of buckets, so the scan skips what lies between them.
A version counts once its manifest row is READY, which is written last, after what lies on disk was read back
and gave the same digests.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import digests

#: Children of a tree's node, and levels above the leaves: FAN ** LEVELS buckets.
FAN, LEVELS = 16, 3
#: Statuses of a key between two versions.
ADDED, REMOVED, CHANGED = "ADDED", "REMOVED", "CHANGED"

_LEAVES = "bucket int, n long, digest string, build string"
_MANIFEST = "version string, build string, root string, n long, written int, status string, reason string"


class MerkleTable:
    """Versions of a table under one path. A key may be null or repeat; rows that repeat count as often as they are there.

    Digests are of all columns by name and type, so their order means nothing and another schema is another content. A text of
    a timestamp follows the session's time zone: writers of one table use one. The tree has FAN ** levels leaves,
    and no more than that ever reaches the driver; rows never do.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], levels: int = LEVELS) -> None:
        self.spark, self.path, self.key, self.levels = spark, path.rstrip("/"), key, levels

    def _placed(self, rows: DataFrame) -> DataFrame:
        """The rows in a struct, their digest and their bucket."""
        kinds = dict(rows.dtypes)
        digest = digests.row_digest(F.lit(",".join(f"{c} {kinds[c]}" for c in sorted(kinds))), *[F.col(f"`{c}`") for c in sorted(kinds)])
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in self.key]), F.lit(FAN**self.levels)).cast("int")
        return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), digest.alias("digest"), bucket.alias("bucket"))

    def write(self, version: str, rows: DataFrame, parent: str | None = None) -> str:
        """Write a version and give its root digest. What is read back must have the digests of what was to be written.

        The rows are read twice, for digests and for what differs from the parent. A source that gives other rows the
        second time, or storage that does, makes the version FAILED and raises; so does a version that is there already.
        """
        if self._ready(version) is not None:
            raise ValueError(f"version {version} is there already")
        before = self._leaves(parent) if parent is not None else self.spark.createDataFrame([], _LEAVES)
        build = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        placed = self._placed(rows)
        wanted = digests.summed(placed, "bucket")
        at = f"{self.path}/leaves/{build}"
        old = before.select("bucket", F.col("digest").alias("old"), F.col("build").alias("old_build"))
        kept = F.col("digest").eqNullSafe(F.col("old"))
        wanted.join(old, "bucket", "left").select("bucket", "n", "digest", F.when(kept, F.col("old_build")).otherwise(F.lit(build)).alias("build")).write.parquet(at)
        leaves = self.spark.read.parquet(at)
        own = leaves.where(F.col("build") == build)
        # at most FAN ** levels short rows; rebalancing splits a bucket that one key makes large
        new = placed.join(F.broadcast(own.select("bucket")), "bucket", "left_semi")
        new.select("row", "bucket", F.lit(build).alias("build")).hint("rebalance", "bucket").sortWithinPartitions("bucket").write.parquet(f"{self.path}/data/{build}")
        written = own.count()
        reason = "content differs from its source" if written and self._wrong(own).first() else None
        n = leaves.agg(F.sum("n")).first()[0] or 0
        root = self._tree(leaves).where(F.col("level") == self.levels).first().digest
        row = (version, build, root, n, written, "FAILED" if reason else "READY", reason)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        if reason:
            raise ValueError(f"version {version}: {reason}")
        return root

    def manifest(self) -> DataFrame:
        """One row for each write: version, build, root, n, written (buckets), status, reason."""
        from .store import _fs

        fs, at = _fs(self.spark, f"{self.path}/manifest")
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest") if fs.exists(at) else self.spark.createDataFrame([], _MANIFEST)

    def _ready(self, version: str):
        return self.manifest().where((F.col("version") == version) & (F.col("status") == "READY")).orderBy(F.desc("build")).first()

    def _leaves(self, version: str) -> DataFrame:
        got = self._ready(version)
        if got is None:
            raise ValueError(f"version {version} isn't ready")
        return self.spark.read.schema(_LEAVES).parquet(f"{self.path}/leaves/{got.build}")

    def _stored(self, leaves: DataFrame, buckets: list[int] | None = None) -> DataFrame | None:
        """row, digest and bucket of what lies in some leaves, or of some buckets of them; None if there are none."""
        builds = [r.build for r in leaves.select("build").distinct().collect()]  # no more than there are leaves
        if not builds:
            return None
        stored = self.spark.read.parquet(*[f"{self.path}/data/{b}" for b in builds])
        own = leaves.select("bucket", "build")
        if buckets is not None:
            stored, own = stored.where(F.col("bucket").isin(buckets)), own.where(F.col("bucket").isin(buckets))
        return self._placed(stored.join(F.broadcast(own), ["bucket", "build"], "left_semi").select("row.*"))

    def _wrong(self, leaves: DataFrame) -> DataFrame:
        """bucket, n, digest, found of the leaves whose rows on disk give another digest."""
        stored = self._stored(leaves)
        if stored is None:
            return leaves.select("bucket", "n", "digest", F.col("digest").alias("found")).where(F.lit(False))
        found = digests.summed(stored, "bucket").select("bucket", F.col("digest").alias("found"))
        return leaves.select("bucket", "n", "digest").join(found, "bucket", "full_outer").where(~F.col("digest").eqNullSafe(F.col("found")))

    def wrong(self, version: str) -> DataFrame:
        """The same for a whole version: what storage lost or altered since it was written. A folder that is gone raises."""
        return self._wrong(self._leaves(version))

    def rows(self, version: str) -> DataFrame:
        """A version's rows. An empty one has no rows and no columns but the key's, as texts."""
        stored = self._stored(self._leaves(version))
        if stored is None:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in self.key))
        return stored.select("row.*")

    def _tree(self, leaves: DataFrame) -> DataFrame:
        """level, node, digest: leaves at level 0, the root alone at the last one. A node has at most FAN children."""
        level = leaves.select(F.lit(0).alias("level"), F.col("bucket").alias("node"), "digest")
        out = level
        children = F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])))
        for i in range(1, self.levels + 1):
            if i < self.levels:
                up = level.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("parent")).agg(F.sha2(children, 256).alias("digest"))
            else:  # of an empty table too
                up = level.agg(F.sha2(children, 256).alias("digest")).select(F.lit(0).alias("parent"), "digest")
            level = up.select(F.lit(i).alias("level"), F.col("parent").alias("node"), "digest")
            out = out.unionByName(level)
        return out

    def tree(self, version: str) -> DataFrame:
        """level, node, digest of a version's tree."""
        return self._tree(self._leaves(version))

    def differing(self, before: str, after: str) -> list[int]:
        """Buckets that differ: from the root down, a level's nodes are compared only below nodes that differ."""
        a, b = self.tree(before), self.tree(after).withColumnRenamed("digest", "other")
        apart = a.join(b, ["level", "node"], "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("level", "node")
        nodes = {(r.level, r.node) for r in apart.collect()}
        found = [0] if (self.levels, 0) in nodes else []
        for level in range(self.levels - 1, -1, -1):
            found = [c for n in found for c in range(n * FAN, n * FAN + FAN) if (level, c) in nodes]
        return found

    def changes(self, before: str, after: str) -> DataFrame:
        """The key, status, n_before and n_after of each key whose rows differ between two versions; a null key is one key.

        Rows of buckets that differ are read, and of no other. They meet as counts of equal rows, summed before they move.
        """
        buckets, sides = self.differing(before, after), []
        for version, here in ((before, 1), (after, 0)):
            stored = self._stored(self._leaves(version).where(F.col("bucket").isin(buckets)), buckets)
            if stored is not None:
                sides.append(stored.select(*[F.col(f"row.`{c}`").alias(c) for c in self.key], "digest", F.lit(here).alias("b"), F.lit(1 - here).alias("a")))
        if not sides:
            return self.rows(before).select(*[F.col(f"`{c}`") for c in self.key], F.lit("").alias("status"), F.lit(0).cast("long").alias("n_before"), F.lit(0).cast("long").alias("n_after")).where(F.lit(False))
        both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        keys: list[Column] = [F.col(f"`{c}`") for c in self.key]
        counts = both.groupBy(*keys, "digest").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
        each = counts.groupBy(*keys).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"), F.count_if(F.col("b") != F.col("a")).alias("moved"))
        status = F.when(F.col("n_before") == 0, ADDED).when(F.col("n_after") == 0, REMOVED).otherwise(CHANGED)
        return each.where("moved > 0").select(*keys, status.alias("status"), "n_before", "n_after")
