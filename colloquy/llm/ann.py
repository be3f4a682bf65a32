"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard, searched by beams.

Distinct vectors are dealt into shards of bounded size. In a shard, points join the graph in rounds: a
greedy search from the medoid proposes neighbours, and relaxed pruning keeps an edge to a neighbour only if
no kept neighbour is closer to it by the factor alpha, so edges point in diverse directions. Queries come in
blocks; each shard goes to one task, where the blocks follow it and are searched one after the other, and the
nearest of all shards are ranked by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, small_batches

SHARD, QUERY_BLOCK = 4096, 2048
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 28, 56, 96, 1.2


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the ids (-1 for none) and squared distances of the beam, all rows in step; x, q: unit vectors."""
    n, b = len(x), len(q)
    rows = np.arange(b)
    ids, dist = np.full((b, beam), -1, np.int32), np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, 2 - 2 * q @ x[start], False
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    while True:
        pick = np.where(done, np.inf, dist).argmin(1)
        live = np.flatnonzero(~done[rows, pick])
        if not len(live):
            return ids, dist
        done[live, pick[live]] = True
        near = graph[ids[live, pick[live]]]
        new = (near >= 0) & ~seen[live[:, None], near]
        at, nth = np.nonzero(near >= 0)  # -1 would stand for the last point
        seen[live[at], near[at, nth]] = True
        d = np.where(new, 2 - 2 * np.matmul(x[near], q[live][:, :, None])[:, :, 0], np.inf).astype(np.float32)
        all_d = np.concatenate((dist[live], d), 1)
        keep = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate((ids[live], np.where(new, near, -1)), 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate((done[live], ~new), 1), keep, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of points among found (-1 for none), nearest first, -1 where there are fewer."""
    vectors = x[found]
    own = 2 - 2 * np.matmul(vectors, x[points][:, :, None])[:, :, 0]
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    open_ = (found >= 0) & (found != points[:, None])
    out, rows = np.full((len(points), degree), -1, np.int32), np.arange(len(points))
    for k in range(degree):
        pick = np.where(open_, own, np.inf).argmin(1)
        some = open_[rows, pick]
        if not some.any():
            break
        out[some, k] = found[rows, pick][some]
        open_ &= (alpha * alpha * between[rows, pick] > own) & (found != found[rows, pick][:, None])
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> tuple[np.ndarray, int]:
    """Neighbours of each unit vector, and where searches start."""
    n = len(x)
    start = int((x @ x.mean(0)).argmax())
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([start], order[order != start])).astype(np.int32)
    at, size = 1, 16
    while at < n:
        points = order[at : at + size]
        found, _ = beam_search(x, graph, start, x[points], beam)
        if at < beam:  # the first rounds know too few points: propose all
            found = np.concatenate((found, np.broadcast_to(order[:at], (len(points), at))), 1)
        graph[points] = robust_prune(x, points, found, degree, alpha)
        # edges back; a point that has too many is pruned again
        target = graph[points].ravel()
        source = np.repeat(points, degree)[target >= 0]
        target = target[target >= 0]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(heads), int(count.max(initial=0))), -1, np.int32)
        extra[np.repeat(np.arange(len(heads)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        both = np.concatenate((graph[heads], extra), 1)
        for a in range(0, len(heads), 512):
            part = heads[a : a + 512]
            merged = both[a : a + 512]
            merged = np.take_along_axis(merged, np.argsort(merged < 0, 1, kind="stable"), 1)
            crowded = (merged >= 0).sum(1) > degree
            graph[part[~crowded]] = merged[~crowded][:, :degree]
            if crowded.any():
                graph[part[crowded]] = robust_prune(x, part[crowded], merged[crowded], degree, alpha)
        at += len(points)
        size = min(512, 2 * size)
    return graph, start


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows; that changes no digit of a cosine."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; scaled by the largest part first, so no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def usable(embedding: str = "embedding"):
    """Whether a vector takes part: not null or zero, and every component finite."""
    c = F.col(embedding)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length, none of them null or with nulls, as a matrix."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])]
    return np.concatenate(flat).astype(np.float64, copy=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (vec_id, embedding) found for each query, without its own id.

    Ties go to the smaller vec_id; equal vectors are one point of the graph that stands for its k + 1 smallest
    ids, which are all that any query can need. Vectors that are null, zero or not finite take no part on either
    side, and vectors are compared with those of their own length. Repeated equal rows count once. Fewer
    than k candidates give fewer rows; an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable() & F.col("vec_id").isNotNull())
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    first = own(vectors).withColumn("nth", F.dense_rank().over(by_vector)).where(F.col("nth") <= k + 1)
    points = materialize(first.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("dim", F.size("embedding")), "points")
    shards = max(1, ceil(points.count() / shard))

    def graphs(key: tuple, table: pa.Table) -> pa.Table:
        v, ids = _matrix(table.column("embedding")), np.full((table.num_rows, k + 1), -1, np.int64)
        counts = np.zeros(table.num_rows, np.int64)
        for i, x in enumerate(table.column("ids").to_pylist()):
            ids[i, : len(x)], counts[i] = x, len(x)
        graph, start = build(unit(v))
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "start": [start], "v": [v.tobytes()], "ids": [ids.tobytes()], "counts": [counts.tobytes()], "graph": [graph.tobytes()]}, schema=shard_schema)

    shard_schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("start", pa.int32()), ("v", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("graph", pa.binary())])
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    built = materialize(dealt.groupBy("dim", "shard").applyInArrow(graphs, "dim int, shard int, start int, v binary, ids binary, counts binary, graph binary"), "graphs")

    asked = own(queries).dropDuplicates(["vec_id", "embedding"])
    blocks = max(1, ceil(asked.count() / QUERY_BLOCK))

    def block(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "q": [_matrix(table.column("embedding")).tobytes()], "q_ids": [np.array(table.column("vec_id").to_pylist(), np.int64).tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("q", pa.binary()), ("q_ids", pa.binary())]))

    asked = asked.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    packed = asked.groupBy("dim", "block").applyInArrow(block, "dim int, block int, q binary, q_ids binary")
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # a shard moves once, and its task meets it before the blocks: it isn't copied beside each of them
    both = built.withColumn("block", F.lit(-1)).unionByName(sent, allowMissingColumns=True)
    met = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            for row in range(b.num_rows):
                r = b.slice(row, 1).to_pylist()[0]
                if r["v"] is not None:
                    at, held = (r["dim"], r["shard"]), _Shard(r, k)
                elif at == (r["dim"], r["shard"]):  # else no vector of this length is in the shard
                    yield held.search(r["q"], r["q_ids"])

    found = met.select("dim", "shard", "start", "v", "ids", "counts", "graph", "q", "q_ids").mapInArrow(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Shard:
    """A shard's vectors and graph, made ready once for all blocks of queries."""

    def __init__(self, r: dict, k: int) -> None:
        self.k, self.dim, self.start = k, r["dim"], r["start"]
        self.v, self.ids, self.counts = scaled(np.frombuffer(r["v"]).reshape(-1, self.dim)), np.frombuffer(r["ids"], np.int64).reshape(-1, k + 1), np.frombuffer(r["counts"], np.int64)
        self.graph = np.frombuffer(r["graph"], np.int32).reshape(len(self.v), -1)
        self.norms, self.x = np.sqrt((self.v * self.v).sum(1)), unit(self.v)

    def search(self, block: bytes, block_ids: bytes) -> pa.RecordBatch:
        """The k best ids of the shard for each query of one block."""
        q, q_ids = scaled(np.frombuffer(block).reshape(-1, self.dim)), np.frombuffer(block_ids, np.int64)
        unit_q = unit(q)
        out: list[list] = [[], [], []]
        for at in range(0, len(q), 512):
            near, dist = beam_search(self.x, self.graph, self.start, unit_q[at : at + 512], SEARCH_BEAM)
            near = np.take_along_axis(near, np.argsort(dist, 1, kind="stable")[:, : 4 * self.k], 1)
            for one, own, candidates in zip(q[at : at + 512], q_ids[at : at + 512].tolist(), near, strict=True):
                candidates = candidates[candidates >= 0]
                scores = (self.v[candidates] * one).sum(1) / (self.norms[candidates] * np.sqrt((one * one).sum()))
                best = sorted((-s, i) for s, c in zip(scores.tolist(), candidates.tolist(), strict=True) for i in self.ids[c, : self.counts[c]].tolist() if i != own)[: self.k]
                out[0] += [own] * len(best)
                out[1] += [i for _, i in best]
                out[2] += [-s for s, _ in best]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])
