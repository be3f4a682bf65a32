"""BM25 of a small set of queries over a whole table, without an index: texts are read and cut into tokens once.

What a document holds of the queries' terms is counted where it is read and kept as numbers in a folder that all
executors share; documents and words are never shuffled. A larger set of queries is joined (`retrieval.bm25`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..sources.store import small_batches
from . import retrieval as rt
from .similarity import single

#: Queries that are scored together at most, pairs of query and term that go to every task, and documents scored at a time.
QUERIES, TERMS, ROWS = 2_000, 50_000, 256
#: Scores so near the k-th are left to the exact order of rounded ones.
TIE = 2e-6
COUNTS = "id long, length int, at array<int>, tf array<int>"
PAIRS = "number int, id long, bm25 double"


def frequencies(documents: DataFrame) -> DataFrame:
    """term, df of all terms of documents (id, document); rows of one id are one document."""
    words = single(documents, "id", "document").select(F.explode(F.array_distinct(tx.tokens(F.col("document")))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df"))


def counts(documents: DataFrame, terms: list[str], folder: str) -> DataFrame:
    """COUNTS of each document: its tokens, and number and frequency of those among the terms; written to the folder."""
    known = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = np.asarray(lists.offsets, np.int64)
            length = np.diff(ends)
            words = pc.fill_null(pc.index_in(lists.values.slice(ends[0], ends[-1] - ends[0]), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(length)), length)
            there = words >= 0
            found, tf = np.unique(row[there] * len(known) + words[there], return_counts=True)
            own = np.searchsorted(found, np.arange(len(length) + 1) * len(known)).astype(np.int32)
            at = pa.ListArray.from_arrays(pa.array(own), pa.array((found % max(len(known), 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length.astype(np.int32)), at, pa.ListArray.from_arrays(pa.array(own), pa.array(tf.astype(np.int32)))], ["id", "length", "at", "tf"])

    spark = documents.sparkSession
    rows = single(documents, "id", "document").select(F.col("id").cast("long").alias("id"), tx.tokens(F.col("document")).alias("t"))
    with small_batches(spark):
        rows.mapInArrow(count, COUNTS).write.parquet(folder)
    return spark.read.schema(COUNTS).parquet(folder)


def scores(documents: DataFrame, queries: DataFrame, folder: str, k: int | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, bm25 of each document that has a term of the query; with k, at least each query's first k by rounded score and id.

    documents: id, document; queries: query_id, query. Repeated terms of a query count once; rows of one id are one
    document, but each row counts in the number of documents.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b within 0 and 1")
    asked = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term")).distinct()
    pairs = asked.limit(TERMS + 1).collect()  # no more than go to every task
    names = sorted({r.query_id for r in pairs}, key=lambda x: (x is None, x))
    if len(pairs) > TERMS or len(names) > QUERIES:
        return rt.bm25(single(documents, "id", "document"), queries, k1, b)
    spark = documents.sparkSession
    terms = sorted({r.term for r in pairs})
    number, place = {t: i for i, t in enumerate(terms)}, {q: i for i, q in enumerate(names)}
    by_term = np.array(sorted((number[r.term], place[r.query_id]) for r in pairs), np.int64).reshape(-1, 2)
    first = np.searchsorted(by_term[:, 0], np.arange(len(terms) + 1))
    held = counts(documents, terms, folder)
    documents_ = documents.where("id is not null").count()
    mean = max((held.agg(F.sum("length")).first()[0] or 0) / max(documents_, 1), 1e-9)
    df = np.zeros(len(terms))
    for r in held.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row for each term
        df[r["at"]] = r["count"]
    idf = np.log1p((documents_ - df + 0.5) / (df + 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((k or 0, len(names)), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids, length, at = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), part.column(2)
                own = np.diff(np.asarray(at.offsets, np.int64))
                t, tf = at.flatten().to_numpy(zero_copy_only=False), part.column(3).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(own)), own)
                weight = idf[t] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length[row] / mean))
                n = first[t + 1] - first[t]
                each = np.repeat(np.arange(len(t)), n)
                query = by_term[np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + first[t][each], 1]
                total = np.bincount(row[each] * len(names) + query, weights=weight[each], minlength=len(own) * len(names)).reshape(len(own), len(names))
                there = total > 0
                if k:
                    best = np.partition(np.vstack([best, np.where(there, total, -np.inf)]), len(own), axis=0)[-k:]
                    there &= total >= best.min(axis=0) - TIE
                r, q = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[r]), pa.array(total[r, q])], ["number", "id", "bm25"])

    kind = asked.schema["query_id"].dataType.simpleString()
    told = spark.createDataFrame(list(enumerate(names)), f"number int, query_id {kind}")
    return held.mapInArrow(score, PAIRS).join(F.broadcast(told), "number").select("query_id", "id", "bm25")  # a row a query
