"""Distinct counts and their set algebra over sliding windows: exact, and from bottom-k sketches.

A sketch (KMV, bottom-k) is the k smallest 64-bit hashes of a set, sorted. Two sketches merge by union and
truncation, so the sketch of a window is that of its days in any order. Of a pair of sets, the k smallest hashes
of both sketches together are a random sample of the union: its k-th hash tells how many members the union has,
and the share of the sample that stands in both sketches, or in the first alone, is scaled to the union. Sets of
fewer than k members are held whole and counted without error.

Both ways start from one row for each client, kind and day. Days of a client and kind that windows join are one
run; a run adds one client to its windows where it begins and takes it away after its end, so exact counts are
sums of such steps, and nothing is counted again for each day. What passes through one task is bounded by kinds and
days, never by rows: steps are summed before they move, a day's sketches merge in salted groups first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, small_batches

#: Hashes in a sketch at most.
K = 2048
#: Days in a window, and how long before A's end B's window ends.
DAYS, BEFORE = 28, 30
#: Groups in which the sketches of tasks merge first, so no task merges those of all tasks.
SALTS = 64
#: Kinds at most: the result holds each pair of them on each day, and their list goes to each task.
MAX_KINDS = 1_000
#: Standard deviations of the stated error.
Z = 3.0

RESULT = "day long, kind_a string, kind_b string, n_union long, n_both long, n_only_a long, est_union double, est_both double, est_only_a double, err_union double, err_both double, err_only_a double"
NONE = np.zeros(0, np.uint64)


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of the sets of some sketches: union, then truncation."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else NONE


def estimate(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float, float, float, float, float]:
    """Members of the union, of both, and of the first alone, and the errors of these three.

    The errors are Z standard deviations: of the k-th smallest of n uniform hashes for the union, and a Wilson interval
    of the binomial share of the sample, narrowed for drawing without replacement, times the union for the others.
    """
    union = merge([a, b], k)
    in_a = np.isin(union, a, assume_unique=True)
    both = int(np.count_nonzero(in_a & np.isin(union, b, assume_unique=True)))
    only = int(np.count_nonzero(in_a)) - both
    if len(union) < k:
        return float(len(union)), float(both), float(only), 0.0, 0.0, 0.0
    n = (k - 1) / ((float(union[-1]) + 1) / 2.0**64)
    left = max(0.0, 1 - k / n)  # of the union, what isn't in the sample
    err = Z * n * math.sqrt(left / (k - 2))

    def share(count: int) -> tuple[float, float]:
        p, z2 = count / k, Z * Z * left / k
        middle, reach = (p + z2 / 2) / (1 + z2), math.sqrt(z2 * p * (1 - p) + z2 * z2 / 4) / (1 + z2)
        sample = max(middle + reach - p, p - middle + reach) * n
        return p * n, math.sqrt(sample * sample + (p * err) * (p * err)) + 1

    (est_both, err_both), (est_only, err_only) = share(both), share(only)
    return n, est_both, est_only, err + 1, err_both, err_only


def used(clicks: DataFrame) -> DataFrame:
    """client, kind, day, h (the 64-bit hash of the client), once each: the rows that have all three."""
    rows = clicks.select(F.col("client_id").cast("long").alias("client"), F.col("kind").cast("string").alias("kind"), F.unix_date(F.to_date("ts")).cast("int").alias("day"))
    return rows.dropna().distinct().withColumn("h", hash64(F.col("client")))


def hash64(client: Column) -> Column:
    """The first 64 bits of the MD5 of the id as text, as a signed long."""
    return F.conv(F.substring(F.md5(client.cast("string")), 1, 16), 16, -10).cast("long")


def steps(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How window counts change: kind, day, step for a kind's clients, and kind_a, kind_b, day, step for clients of both."""
    # dealt by client once: the order of days, the runs and the join of a client's runs all keep that; a client has a row for each kind and day at most
    one = Window.partitionBy("client", "kind").orderBy("day")
    marked = rows.select("client", "kind", "day").repartition("client").withColumn("new", F.coalesce(F.col("day") - F.lag("day").over(one) > DAYS, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(one)).groupBy("client", "kind", "run").agg(F.min("day").alias("first"), (F.max("day") + DAYS - 1).alias("last"))

    def turned(of: DataFrame, *keys: str) -> DataFrame:
        ends = F.explode(F.array(F.struct(F.col("first").alias("day"), F.lit(1).alias("step")), F.struct((F.col("last") + 1).alias("day"), F.lit(-1).alias("step")))).alias("e")
        return of.select(*keys, ends).groupBy(*keys, "e.day").agg(F.sum("e.step").alias("step"))

    a = runs.select("client", F.col("kind").alias("kind_a"), F.col("first").alias("fa"), F.col("last").alias("la"))
    b = runs.select("client", F.col("kind").alias("kind_b"), (F.col("first") + BEFORE).alias("fb"), (F.col("last") + BEFORE).alias("lb"))
    shared = a.join(b, "client").where("fa <= lb and fb <= la").select("kind_a", "kind_b", F.greatest("fa", "fb").alias("first"), F.least("la", "lb").alias("last"))
    return turned(runs, "kind"), turned(shared, "kind_a", "kind_b")


def exact(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """day, kind_a, kind_b and the exact counts, for each day that has a row and each ordered pair of kinds."""
    single, double = steps(rows)
    every = lambda name: F.explode(F.lit(kinds)).alias(name)
    zero = F.lit(0).cast("long")
    parts = [
        single.select(F.col("kind").alias("kind_a"), every("kind_b"), "day", F.col("step").alias("a"), zero.alias("b"), zero.alias("both"), zero.alias("there")),
        single.select(every("kind_a"), F.col("kind").alias("kind_b"), (F.col("day") + BEFORE).alias("day"), zero.alias("a"), F.col("step").alias("b"), zero.alias("both"), zero.alias("there")),
        double.select("kind_a", "kind_b", "day", zero.alias("a"), zero.alias("b"), F.col("step").alias("both"), zero.alias("there")),
        rows.select("day").distinct().select(every("kind_a"), "day").select("kind_a", every("kind_b"), "day", zero.alias("a"), zero.alias("b"), zero.alias("both"), F.lit(1).cast("long").alias("there")),
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    by_day = whole.groupBy("kind_a", "kind_b", "day").agg(*(F.sum(c).alias(c) for c in ("a", "b", "both", "there")))
    so_far = Window.partitionBy("kind_a", "kind_b").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    counts = by_day.select("kind_a", "kind_b", "day", "there", *(F.sum(c).over(so_far).alias(c) for c in ("a", "b", "both"))).where("there > 0")
    return counts.select(F.col("day").cast("long").alias("day"), "kind_a", "kind_b", (F.col("a") + F.col("b") - F.col("both")).alias("n_union"), F.col("both").alias("n_both"), (F.col("a") - F.col("both")).alias("n_only_a"))


def _merged(rows: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """One sketch for each key (columns keys, then sketch); a task holds one sketch and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, done = None, NONE, []
        for b in batches:
            for *key, sketch in zip(*(b.column(i).to_pylist() for i in range(len(keys) + 1)), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, held.tobytes()))
                    at, held = key, NONE
                held = merge([held, np.frombuffer(sketch, np.uint64)])
            yield _rows(done, schema)
            done = []
        if at is not None:
            yield _rows([(*at, held.tobytes())], schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "sketch").mapInArrow(run, schema)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def daily(rows: DataFrame) -> DataFrame:
    """kind, day, sketch of the day's hashes: each task sketches its own rows, the tasks' sketches merge in salted groups, then by day."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        size = 0
        for b in batches:
            frame = pd.DataFrame({"kind": b.column(0).to_pandas(), "day": b.column(1).to_numpy(), "h": b.column(2).to_numpy().view(np.uint64)})
            for key, h in frame.groupby(["kind", "day"], sort=False)["h"]:
                held.setdefault(key, []).append(h.to_numpy())
            size += b.num_rows
            if size > 1 << 20:  # what k leaves behind goes
                held = {key: [merge(parts)] for key, parts in held.items()}
                size = 0
        salt = TaskContext.get().partitionId() % SALTS
        for key, parts in held.items():
            yield _rows([(*map(_plain, key), salt, merge(parts).tobytes())], "kind string, day int, salt int, sketch binary")

    small_batches(rows.sparkSession, 65_536)
    own = rows.select("kind", "day", "h").mapInArrow(run, "kind string, day int, salt int, sketch binary")
    salted = _merged(own, ["kind", "day", "salt"], "kind string, day int, salt int, sketch binary")
    return _merged(salted, ["kind", "day"], "kind string, day int, sketch binary")


def _plain(x: object) -> object:
    return int(x) if isinstance(x, np.integer) else x


def windows(days: DataFrame) -> DataFrame:
    """kind, day, sketch of the DAYS days that end with that day, for each day whose window has a client.

    A day goes to its block of DAYS days and to the next one; within a block, a window is a tail of the block before
    and a head of its own, each made by merging one day more.
    """
    block = F.floor(F.col("day") / DAYS).cast("int")
    twice = days.select("kind", F.explode(F.array(block, block + 1)).alias("block"), "day", "sketch")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, at = (x.as_py() for x in key)
        own = {d: np.frombuffer(s, np.uint64) for d, s in zip(table["day"].to_pylist(), table["sketch"].to_pylist(), strict=True)}
        first, tails, head, out = at * DAYS, [NONE], NONE, []
        for d in range(first - 1, first - DAYS, -1):
            tails.append(merge([tails[-1], own[d]]) if d in own else tails[-1])
        for i in range(DAYS):
            head = merge([head, own[first + i]]) if first + i in own else head
            sketch = merge([head, tails[DAYS - 1 - i]])
            if len(sketch):
                out.append((kind, first + i, sketch.tobytes()))
        return pa.Table.from_batches([_rows(out, "kind string, day int, sketch binary")])

    return twice.groupBy("kind", "block").applyInArrow(run, "kind string, day int, sketch binary")


def estimates(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """day, kind_a, kind_b and what sketches tell, for pairs of which either window has a client and whose day has a row."""
    sketches = windows(daily(rows))
    # a day's task holds two sketches for each kind
    both = sketches.select("day", "kind", F.lit(0).alias("side"), "sketch").unionByName(sketches.select((F.col("day") + BEFORE).alias("day"), "kind", F.lit(1).alias("side"), "sketch"))
    there = both.join(rows.select("day").distinct(), "day", "left_semi")
    names = ("est_union", "est_both", "est_only_a", "err_union", "err_both", "err_only_a")
    schema = "day long, kind_a string, kind_b string, " + ", ".join(f"{n} double" for n in names)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        day = key[0].as_py()
        sides: list[dict[str, np.ndarray]] = [{}, {}]
        for kind, side, sketch in zip(table["kind"].to_pylist(), table["side"].to_pylist(), table["sketch"].to_pylist(), strict=True):
            sides[side][kind] = np.frombuffer(sketch, np.uint64)
        out = [(day, a, b, *estimate(sides[0].get(a, NONE), sides[1].get(b, NONE))) for a in kinds for b in kinds if a in sides[0] or b in sides[1]]
        return pa.Table.from_batches([_rows(out, schema)])

    return there.groupBy("day").applyInArrow(run, schema)


def window_algebra(clicks: DataFrame) -> DataFrame:
    """For each day with a used row and each ordered pair of kinds: exact counts, estimates from sketches and their errors.

    A is kind_a's clients in the DAYS days that end with the day, B kind_b's in the DAYS days that end BEFORE days
    earlier. Rows without client_id, kind or ts aren't used; repeated rows count once; other columns aren't read. An
    empty table, or one without a used row, gives no rows. Pairs of two empty sets have zero everywhere. More kinds than
    MAX_KINDS are an error, as the result holds their square.
    """
    rows = materialize(used(clicks), "used")
    kinds = sorted(r.kind for r in rows.select("kind").distinct().limit(MAX_KINDS + 1).collect())
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds")
    if not kinds:
        return clicks.sparkSession.createDataFrame([], RESULT)
    told = exact(rows, kinds).join(estimates(rows, kinds), ["day", "kind_a", "kind_b"], "left")
    return told.select("day", "kind_a", "kind_b", "n_union", "n_both", "n_only_a", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("est_union", "est_both", "est_only_a", "err_union", "err_both", "err_only_a")))
