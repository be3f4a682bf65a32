"""Texts near a query by the cosine of smoothed tf-idf vectors, over words, CJK signs and pairs of signs.

A set of queries that fits into a task meets each document where its text is read, so neither texts nor counts move: the first
pass counts documents by term, the second makes dots and norms. Terms beyond the commonest, whose weights don't go to
the tasks, only make a norm longer; they are looked up for documents that could be near a query without them.

A larger set is joined. Only terms that stand early in the order of rarity can join a document with a query: what follows
them is too short to reach the wanted cosine by itself. So common terms, which would join everything, meet nothing but chosen pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.store import small_batches
from .retrieval import SMALL

#: Commonest terms, whose weights go to every task; none of the others holds more than one part in so many of the postings.
COMMON = 100_000
#: A pair this little below the bound is still compared, as sums are rounded.
SLACK = 1e-9
#: Queries that meet documents in a task at most, and their pairs of query and term.
QUERIES, TERMS = 2_000, 50_000
#: Terms that a task counts before it passes them on, and their characters.
HELD, HELD_CHARS = 50_000, 4_000_000
MET = "square double, number array<int>, dot array<double>, term array<string>, tf array<long>"
_WORD = re.compile(r"\b[a-z0-9_.]+\b")
_SIGN = re.compile(r"[一-鿿]")


def terms(text: str) -> list[str]:
    """Words of letters a to z, digits, underscores and dots; CJK signs; and each CJK sign with the next one."""
    low = text.lower()
    signs = _SIGN.findall(low)
    return _WORD.findall(low) + signs + [a + b for a, b in pairwise(signs)]


def single(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, text with a row a key: rows of one key are one text, in the order of their texts. Only keys that repeat are moved."""
    rows = rows.select(key, F.col(text).cast("string").alias(text)).where(F.col(key).isNotNull())
    again = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    n = again.limit(SMALL + 1).count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= SMALL else again
    merged = rows.join(again, key, "left_semi").groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias(text))
    return rows.join(again, key, "left_anti").unionByName(merged)


def frequencies(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, counted where the texts are read; keys are not repeated."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, t in enumerate(b.column(1).to_pylist()):
                found = Counter(terms(t)) if t else {}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[at], len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], [key, "term", "tf"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(count, f"`{key}` {kind}, term string, tf long")


def document_frequencies(texts: DataFrame, text: str) -> DataFrame:
    """term, df of rows of text. A task passes its counts on whenever it holds many terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        chars = 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in set(terms(t)) if t else ():
                    n = held.get(w, 0)
                    held[w] = n + 1
                    chars += 0 if n else len(w)
                if len(held) > HELD or chars > HELD_CHARS:
                    yield made()
                    held.clear()
                    chars = 0
        yield made()

    return texts.select(text).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def inverse_frequencies(df: DataFrame, documents: int) -> DataFrame:
    """term, df, idf: ln((documents + 1) / (df + 1)) + 1."""
    return df.select("term", "df", (F.log((F.lit(documents) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def early(rows: DataFrame, key: str, least: float) -> DataFrame:
    """Terms, rarest first, of each key until the rest is shorter than `least` of its whole vector; rows: key, term, df, w, norm."""
    before = Window.partitionBy(key).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("w") * F.col("w")
    left = F.sum(square).over(Window.partitionBy(key)) - F.coalesce(F.sum(square).over(before), F.lit(0.0))
    return rows.withColumn("left", left).where(F.col("left") >= (least * least - SLACK) * F.col("norm") * F.col("norm")).drop("left")


def near(documents: DataFrame, queries: DataFrame, least: float, folder: str) -> DataFrame:
    """query_id, id, similarity of each document (id, document) and query (query_id, query) whose cosine is `least` or more; exact.

    least is over 0 and at most 1. Terms that no document has don't count. A null or empty text is near nothing, rows
    with a null id take no part, rows of one id are one text, and other columns aren't read. Frequencies of terms and
    what documents hold of the queries are written below `folder`, which all executors share.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    own, queries = single(documents, "id", "document"), single(queries, "query_id", "query")
    words = frequencies(queries, "query_id", "query").limit(TERMS + 1).collect()  # no more than go to every task
    if len(words) > TERMS or len({r.query_id for r in words}) > QUERIES:
        return _joined(own, queries, least, folder)
    return _met(own, words, queries.schema["query_id"].dataType.simpleString(), least, folder)


def _met(own: DataFrame, words: list, query_kind: str, least: float, folder: str) -> DataFrame:
    """near() for queries that fit into a task; words: query_id, term, tf."""
    spark = own.sparkSession
    with small_batches(spark):
        totals = inverse_frequencies(document_frequencies(own, "document"), own.count())
        totals.write.parquet(f"{folder}/terms")
    idf = spark.read.schema(totals.schema).parquet(f"{folder}/terms")
    asked = spark.createDataFrame([(t,) for t in sorted({r.term for r in words})], "term string")
    weight = {r.term: r.idf for r in idf.join(F.broadcast(asked), "term").collect()}  # no more than the queries have
    names = sorted({r.query_id for r in words if r.term in weight})
    place, number = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(sorted(weight))}
    many = len(number)
    pairs = sorted((number[r.term], place[r.query_id], r.tf * weight[r.term]) for r in words if r.term in weight)
    at, query, share = (np.array([p[i] for p in pairs], kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
    first = np.searchsorted(at, np.arange(many + 1))
    q_norm = np.sqrt(np.bincount(query, share * share, len(names)))
    for r in idf.orderBy(F.desc("df"), "term").limit(COMMON).collect():  # a bounded number
        weight[r.term] = r.idf
        number.setdefault(r.term, len(number))
    weights = np.array([weight[t] for t in number], np.float64)
    told = spark.sparkContext.broadcast(list(number))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(told.value)}
        for b in batches:
            counts = [Counter(terms(t)) if t else {} for t in b.column(1).to_pylist()]
            row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            t = np.array([numbers.get(w, -1) for c in counts for w in c], np.int64)
            tf = np.array([n for c in counts for n in c.values()], np.int64)
            there = t >= 0
            w = np.where(there, tf * weights[t], 0.0) if len(weights) else np.zeros(len(t))
            square = np.bincount(row, w * w, len(counts))
            mine = there & (t < many)
            n = (first[t[mine] + 1] - first[t[mine]])
            each = np.repeat(np.arange(len(n)), n)
            pair = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + first[t[mine]][each]
            dot = np.bincount(row[mine][each] * len(names) + query[pair], w[mine][each] * share[pair], len(counts) * len(names)).reshape(len(counts), len(names))
            close = (dot > 0) & (dot >= (least - SLACK) * np.sqrt(square)[:, None] * q_norm)
            kept = close.any(axis=1)
            r, q = np.nonzero(close)
            lists = lambda n, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
            rest = [[(x, n) for x, n in counts[i].items() if x not in numbers] for i in np.nonzero(kept)[0]]
            sizes = [len(x) for x in rest]
            yield pa.RecordBatch.from_arrays([
                b.column(0).filter(pa.array(kept)), pa.array(square[kept]), lists(close.sum(axis=1)[kept], pa.array(q.astype(np.int32))), lists(close.sum(axis=1)[kept], pa.array(dot[r, q])),
                lists(sizes, pa.array([x for y in rest for x, _ in y], pa.string())), lists(sizes, pa.array([n for y in rest for _, n in y], pa.int64())),
            ], ["id", "square", "number", "dot", "term", "tf"])

    schema = f"id {own.schema['id'].dataType.simpleString()}, {MET}"
    with small_batches(spark):
        own.select("id", "document").mapInArrow(meet, schema).write.parquet(f"{folder}/met")
    met = spark.read.schema(schema).parquet(f"{folder}/met")
    # no term is left that many documents have, so this join has no hot key
    rest = met.select("id", F.explode(F.arrays_zip("term", "tf")).alias("x")).select("id", "x.term", "x.tf").join(idf, "term")
    rest = rest.groupBy("id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf")).alias("more"))
    whole = met.select("id", "square", F.explode(F.arrays_zip("number", "dot")).alias("x")).select("id", "square", "x.*").join(rest, "id", "left")
    asking = spark.createDataFrame([(i, q, float(q_norm[i])) for q, i in place.items()], f"number int, query_id {query_kind}, q_norm double")
    similarity = F.col("dot") / (F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0))) * F.col("q_norm"))
    found = whole.join(F.broadcast(asking), "number").select("query_id", "id", similarity.alias("similarity"))  # a row a query
    return found.where(F.col("similarity") >= least - SLACK)


def _joined(own: DataFrame, queries: DataFrame, least: float, folder: str) -> DataFrame:
    """near() for any number of queries: counts are written, and joined with the queries' terms.

    The commonest terms' weights are broadcast, at most COMMON rows, so no other is a hot key, and a document's terms are
    summed where they were counted; only terms that a query has go on. A document's bound covers those alone, as nothing
    else can add to a cosine. A hot group of copies costs its documents times the queries near them, and pairs of
    documents are never made.
    """
    spark = own.sparkSession
    made = frequencies(own, "id", "document")
    made.write.parquet(f"{folder}/counts")
    counted = spark.read.schema(made.schema).parquet(f"{folder}/counts")
    totals = inverse_frequencies(counted.groupBy("term").agg(F.count("*").alias("df")), own.count())
    totals.write.parquet(f"{folder}/terms")
    idf = spark.read.schema(totals.schema).parquet(f"{folder}/terms")

    words = frequencies(queries, "query_id", "query").join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    asked = words.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))).select("query_id", "term", "df", "w", "norm")
    marked = idf.join(words.select("term", F.lit(True).alias("asked")).distinct(), "term", "left")
    common = marked.orderBy(F.desc("df"), "term").limit(COMMON)
    met = counted.join(F.broadcast(common), "term", "left")
    square = F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf")
    rest = met.where("idf is null").select("id", "term", "tf").join(marked.join(F.broadcast(common.select("term")), "term", "left_anti"), "term")
    weighed = met.where("idf is not null").unionByName(rest)
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(square)).alias("norm"), F.max("asked").alias("asked")).where("asked").drop("asked")
    kept = weighed.where("asked").select("id", "term", "df", (F.col("tf") * F.col("idf")).alias("w")).join(norms, "id")
    kept.write.parquet(f"{folder}/kept")
    docs = spark.read.schema(kept.schema).parquet(f"{folder}/kept")
    # a query's early terms are few and rare; documents keep theirs before anything is joined
    pairs = early(docs, "id", least).select("id", "term").join(early(asked, "query_id", least).select("query_id", "term"), "term").select("query_id", "id").distinct()
    both = pairs.join(docs.select("id", "term", "w", "norm"), "id").join(asked.select("query_id", "term", F.col("w").alias("q"), F.col("norm").alias("q_norm")), ["query_id", "term"])
    found = both.groupBy("query_id", "id").agg((F.sum(F.col("w") * F.col("q")) / (F.first("norm") * F.first("q_norm"))).alias("similarity"))
    return found.where(F.col("similarity") >= least - SLACK)
