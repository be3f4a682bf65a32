"""Approximate nearest neighbours: inverted lists of product-quantised residuals, rescored exactly.

Lloyd rounds in Spark train a coarse quantiser on a bounded sample and, on what is left after it, a codebook for each
of PARTS stretches of the components. Every vector is then a list number and one byte a stretch. A query visits its
nearest lists; a list's codes are scored by adding up entries of a table of distances between the query's residual and
the codebooks; the best of all visited lists are rescored with the vectors themselves.

Lists that hold many vectors (equal ones, or a hot cluster) are cut into chunks, and queries go to each chunk; a task
holds one chunk's codes while the queries stream by. Training data is bounded, everything else covers every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as sc
from ..sources.store import scratch
from .retrieval import top

#: Vectors that training looks at, at most, and its rounds.
FIT_ROWS, ROUNDS = 50_000, 5
#: Lists at least and at most (their centres go to each task), and vectors of a list where that allows it.
LISTS, LIST_ROWS = (8, 1_024), 4_096
#: Entries of a codebook, and stretches of the components.
CODES, PARTS = 256, 16
#: Share of the lists that a query visits, and how many times k vectors it rescores. Vectors spread evenly over a sphere, as
#: the test tables', need three quarters of the lists for a recall of 0.95; vectors that lie in clusters need far fewer.
VISITS, POOL = 0.75, 30
#: Vectors in a chunk of a list at most.
CHUNK = 65_536


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """id, embedding (doubles) of the vectors that have `dim` finite components; others, and null ids, take no part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("id").isNotNull() & (F.size("embedding") == dim) & ~bad)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, ties to the first; in blocks, so memory stays small."""
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(half - x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096))])


def lloyd(rows: DataFrame, dim: int, k: int, parts: int = 1, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (parts, k, dim / parts) of rows (id, embedding) by Lloyd's rounds; each stretch of components has its own.

    Tasks sum their rows by centre, Spark adds the sums up; a round brings parts * k centres to the driver, never rows.
    Centres start as the first k rows by hash; a centre without rows stays where it is. Fewer rows than k give fewer centres.
    """
    width = dim // parts
    seeds = np.array([r.embedding for r in rows.dropDuplicates(["embedding"]).orderBy(F.xxhash64("id"), "id").limit(k).collect()], float).reshape(-1, dim)
    centres = seeds.reshape(-1, parts, width).transpose(1, 0, 2).copy()
    if not len(seeds):
        return np.zeros((parts, 0, width))
    schema = "part int, centre int, n long, total array<double>"

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(centres.shape[:2], np.int64), np.zeros(centres.shape)
            for b in batches:
                x = matrix(b.column(0), dim)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    near = nearest_centre(own, centres[p])
                    n[p] += np.bincount(near, minlength=centres.shape[1])
                    np.add.at(total[p], near, own)
            at = np.argwhere(n)
            yield pa.RecordBatch.from_pydict({"part": pa.array(at[:, 0], pa.int32()), "centre": pa.array(at[:, 1], pa.int32()), "n": pa.array(n[n > 0], pa.int64()), "total": pa.array(list(total[n > 0]), pa.list_(pa.float64()))})

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = np.array(table["total"].to_pylist()).sum(0)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "centre": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "total": pa.array([total], pa.list_(pa.float64()))})

        sums = rows.select("embedding").mapInArrow(run, schema).groupBy("part", "centre").applyInArrow(add, schema).collect()
        moved = centres.copy()
        for r in sums:
            moved[r.part, r.centre] = np.array(r.total) / r.n
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            break
        centres = moved
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """codes: list, chunk, id, code; vectors: id, embedding."""

    vectors: DataFrame
    codes: DataFrame
    chunks: DataFrame
    coarse: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    def search(self, queries: DataFrame, k: int, visits: float = VISITS, pool: int = POOL) -> DataFrame:
        """query_id, id, distance (Euclidean, of the vectors themselves), rank: each query's k nearest found, ties to the smaller id.

        queries: query_id, query_vector; unusable ones have no rows. A vector counts like any other if the query is itself in the index.
        """
        dim, width, coarse, books, most = self.dim, self.dim // PARTS, self.coarse, self.books, pool * k
        probes = max(1, int(np.ceil(visits * len(coarse))))
        asked = usable(queries.select(F.col("query_id").alias("id"), F.col("query_vector").alias("embedding")), dim)

        def near_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (coarse * coarse).sum(1) / 2
            for b in batches:
                x = matrix(b.column(1), dim)
                near = np.argsort(half - x @ coarse.T, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(x)), near.shape[1]))), pa.array(near.ravel().astype(np.int32))], ["query_id", "list"])

        went = asked.mapInArrow(near_lists, "query_id long, list int").join(asked.withColumnRenamed("id", "query_id"), "query_id")
        went = went.join(self.chunks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.lit(None).cast("binary").alias("code"), "embedding")
        own = self.codes.select("list", "chunk", F.lit(0).alias("side"), "id", "code", F.lit(None).cast("array<double>").alias("embedding"))
        dealt = own.unionByName(went).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "side", "id")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, codes, flat, known = None, [], [], None, None
            square, place = (books * books).sum(2), np.arange(PARTS)[None, :]
            for b in batches:
                out_q, out_i, out_d = [], [], []
                for at, chunk, side, id_, code, x in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if (at, chunk) != key:
                        key, ids, codes, flat = (at, chunk), [], [], None
                    if not side:
                        ids.append(id_)
                        codes.append(code)
                        continue
                    if not codes:
                        continue
                    if flat is None:
                        flat, known = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, PARTS), np.array(ids, np.int64)
                    rest = (np.array(x) - coarse[at]).reshape(PARTS, width)
                    table = square - 2 * np.einsum("pcw,pw->pc", books, rest)
                    told = table[place, flat].sum(1) + (rest * rest).sum()
                    best = np.argpartition(told, most)[:most] if len(told) > most else np.arange(len(told))
                    out_q.append(np.full(len(best), id_, np.int64))
                    out_i.append(known[best])
                    out_d.append(told[best])
                none = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *out_q])), pa.array(np.concatenate([none, *out_i])), pa.array(np.concatenate([none.astype(float), *out_d]))], ["query_id", "id", "told"])

        told = dealt.mapInArrow(score, "query_id long, id long, told double")
        found = top(told, [F.asc("told"), F.asc("id")], most).select("query_id", "id")
        exact = found.join(self.vectors, "id").join(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("asked")), "query_id")
        return top(exact.select("query_id", "id", sc.euclidean(F.col("embedding"), F.col("asked")).alias("distance")), [F.asc("distance"), F.asc("id")], k)


def build(vectors: DataFrame, dim: int, path: str | None = None, fit_rows: int = FIT_ROWS, chunk: int = CHUNK) -> VectorIndex:
    """An index of all usable vectors (id, embedding) with ids of their own; dim is a multiple of PARTS.

    At most fit_rows of them train the quantisers, the first by hash of their ids; lists are made for LIST_ROWS vectors each,
    within LISTS. The codes are written under path by list; an empty table gives an index that finds nothing.
    """
    if dim % PARTS:
        raise ValueError(f"dim must be a multiple of {PARTS}")
    spark: SparkSession = vectors.sparkSession
    path = path or scratch(spark)
    rows = usable(vectors, dim)
    rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).write.parquet(f"{path}/sample")
    sample = spark.read.schema("id long, embedding array<double>").parquet(f"{path}/sample")
    n = rows.count()
    coarse = lloyd(sample, dim, max(LISTS[0], min(LISTS[1], n // LIST_ROWS)))[0]
    width = dim // PARTS

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x - coarse[nearest_centre(x, coarse)]), pa.list_(pa.float64()))], ["id", "embedding"])

    books = lloyd(sample.mapInArrow(left, "id long, embedding array<double>"), dim, CODES, PARTS) if n else np.zeros((PARTS, 1, width))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            near = nearest_centre(x, coarse)
            rest = x - coarse[near]
            code = np.stack([nearest_centre(rest[:, p * width : (p + 1) * width], books[p]) for p in range(PARTS)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["id", "list", "code"])

    if n:
        rows.mapInArrow(encode, "id long, list int, code binary").write.partitionBy("list").parquet(f"{path}/lists")
        codes = spark.read.schema("id long, code binary, list int").parquet(f"{path}/lists")
    else:
        codes = spark.createDataFrame([], "id long, code binary, list int")
    chunks = codes.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = codes.join(F.broadcast(chunks), "list").select("list", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id", "code")  # a row for each list
    return VectorIndex(rows, dealt, F.broadcast(chunks), coarse, books)
