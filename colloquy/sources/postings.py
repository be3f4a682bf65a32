"""A persisted inverted index: blocks of postings by term and range of ids, in versions that share what hasn't changed.

A segment is a range of SPAN ids; a block holds a term's postings in a segment: places as offsets from the segment's first
id, frequencies, lengths, and their frontier, which is the (frequency, length) pairs that no other of the block beats
in both. BM25 grows with the frequency and falls with the length, so the best of a block is on its frontier, whatever the
statistics of the collection are: these may change without touching a block.

A part is a range of SEGMENTS segments and the unit of writing: a version's manifest names, for each part, the folder
that holds it, and a new version writes only parts whose documents have another digest. In a part, blocks are
dealt into BUCKETS by term, one folder each, so a query opens the buckets of its terms only. Blocks are made where documents
are read, so a block may come in pieces, one of each task that read documents of its segment.

Segments are the same for all terms, so the blocks of a query's terms in a segment bound what a document there can
have. The first k documents are found from the terms that a document needs for a place among them; blocks of the others,
the common words, are read only where such a document is that they could lift to the k-th score.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scoring as sc, text as tx
from ..operators.retrieval import SMALL, top
from .digests import row_digest, summed
from .store import _fs, scratch, small_batches

SPAN, SEGMENTS, BUCKETS = 4096, 256, 32
#: Scores that differ by less are ordered by id: segments so near the k-th score are read too.
TIE = 1e-6
#: Queries that are searched together where blocks are, and their pairs of query and term; larger sets are joined.
QUERIES, TERMS = 2_000, 50_000
#: Postings that a task holds before it makes blocks of them; rows of blocks, and pairs of posting and query, at a time.
HELD, ROWS, PAIRS = 1_500_000, 20_000, 4_000_000

BLOCK = "part long, bucket int, segment long, term string, at array<int>, tf array<int>, length array<int>, frontier array<struct<tf:int,length:int>>"
MANIFEST = "version string, build string, part long, folder string, documents long, length long, digest string, span int, segments int, buckets int"


@dataclass(frozen=True)
class Snapshot:
    """A version that is open: blocks, and the number and whole length of its documents."""

    blocks: DataFrame
    documents: int
    length: int
    span: int
    buckets: int

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _weight(self, tf: Column, df: Column, length: Column, k1: float, b: float) -> Column:
        return sc.okapi(tf, df, length, F.lit(self.documents), F.lit(max(self.length / max(self.documents, 1), 1e-9)), k1, b)

    def frequencies(self) -> DataFrame:
        """term, df of all terms."""
        return self.blocks.groupBy("term").agg(F.sum(F.size("at")).alias("df"))

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks of the queries' terms, from their buckets alone; and query_id, term, df."""
        terms = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))
        few = terms.limit(SMALL + 1).count() <= SMALL
        mark = F.broadcast if few else lambda rows: rows
        buckets = [r.bucket for r in terms.select(self._bucket(F.col("term")).alias("bucket")).distinct().collect()]  # no more than there are
        own = self.blocks.where(F.col("bucket").isin(buckets)).join(mark(terms.select("term").distinct()), "term", "left_semi")
        df = own.groupBy("term").agg(F.sum(F.size("at")).alias("df"))
        return own, mark(terms.join(df, "term"))  # no more rows than terms

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """query_id, id, bm25 of each document that has a term of the query (query_id, query); repeated terms count once."""
        _checked(k1, b)
        own, asked = self._asked(queries)
        rows = self._parts(own.join(asked, "term"), k1, b)
        return rows.select("query_id", (F.col("segment") * self.span + F.col("at")).alias("id"), F.col("part").alias("bm25"))

    def _maxima(self, own: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
        """term, segment, n, most: a block's number of documents and its largest score, from its frontier."""
        df = asked.select("term", "df").distinct()
        most = F.array_max(F.transform("frontier", lambda x: self._weight(x["tf"], F.col("df"), x["length"], k1, b)))
        pieces = own.select("term", "segment", "frontier", F.size("at").alias("n")).join(df, "term").select("term", "segment", "n", most.alias("most"))
        return pieces.groupBy("term", "segment").agg(F.sum("n").cast("int").alias("n"), F.max("most").alias("most"))

    def _plan(self, queries: DataFrame, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Blocks of the queries' terms; their maxima; the queries' terms (df, essential); candidates (query_id, segment, at, part) with their score from essential terms.

        A query's k-th best score is at least the k-th best from its rarer half of terms alone. Terms whose largest scores
        add up to less than that can't lift a document there by themselves, so a document needs one of the others, the essential ones.
        """
        _checked(k1, b)
        spark, kind = queries.sparkSession, dict(queries.dtypes)["query_id"]
        own, asked = self._asked(queries)
        maxima = _kept(self._maxima(own, asked, k1, b), "term string, segment long, n int, most double")
        terms = asked.join(maxima.groupBy("term").agg(F.max("most").alias("most")), "term")
        by_query = Window.partitionBy("query_id")
        terms = _kept(terms.withColumn("rare", F.row_number().over(by_query.orderBy("df", "term")) * 2 <= F.count("*").over(by_query) + 1), f"term string, query_id {kind}, df long, most double, rare boolean")
        small = terms.limit(SMALL + 1).count() <= SMALL
        mark = F.broadcast if small else lambda rows: rows
        first = self._parts(own.join(mark(terms.where("rare")), "term"), k1, b)
        least = top(first, [F.desc("part"), F.asc("segment"), F.asc("at")], k).where(F.col("rank") == k).select("query_id", F.col("part").alias("least"))
        so_far = F.sum("most").over(by_query.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
        known = terms.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - TIE)
        known = _kept(known.select("query_id", "term", "df", "least", (so_far >= F.col("least")).alias("essential")), f"query_id {kind}, term string, df long, least double, essential boolean")
        part = self._parts(own.join(mark(known.where("essential")), "term"), k1, b)
        others = maxima.join(mark(known.where("not essential").select("query_id", "term")), "term").groupBy("query_id", "segment").agg(F.sum("most").alias("others"))
        bound = part.join(mark(known.groupBy("query_id").agg(F.max("least").alias("least"))), "query_id").join(others, ["query_id", "segment"], "left")
        found = bound.where(F.col("part") + F.coalesce("others", F.lit(0.0)) >= F.col("least")).select("query_id", "segment", "at", "part")
        return own, maxima, known, _kept(found, f"query_id {kind}, segment long, at int, part double")

    def _parts(self, blocks: DataFrame, k1: float, b: float) -> DataFrame:
        """query_id, segment, at, part: what some terms' blocks (query_id, df and the postings) give each document."""
        p = blocks.select("query_id", "segment", "df", F.explode(F.arrays_zip("at", "tf", "length")).alias("p")).select("query_id", "segment", "df", "p.*")
        return p.groupBy("query_id", "segment", "at").agg(F.sum(self._weight(F.col("tf"), F.col("df"), F.col("length"), k1, b)).alias("part"))

    def top(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
        """query_id, id, bm25 (rounded), rank: the first k documents of each query by score, then id. No document is lost.

        Postings of terms that aren't essential are read only in segments where a document, with all that the segment's blocks
        of these terms could add, reaches the k-th score.
        """
        _checked(k1, b)
        terms = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term")).distinct()
        pairs = terms.limit(TERMS + 1).collect()  # no more than go to every task
        if len(pairs) <= TERMS and len({r.query_id for r in pairs}) <= QUERIES:
            rows = self._searched(pairs, queries, k, k1, b).select("query_id", "id", F.round("bm25", digits).alias("bm25"))
            return top(rows, [F.desc("bm25"), F.asc("id")], k)
        own, _, known, found = self._plan(queries, k, k1, b)
        rest = own.join(self._others(known, found), ["term", "segment"])
        more = self._parts(rest, k1, b).join(found.select("query_id", "segment", "at"), ["query_id", "segment", "at"], "left_semi")
        whole = found.unionByName(more).groupBy("query_id", "segment", "at").agg(F.sum("part").alias("bm25"))
        rows = whole.select("query_id", (F.col("segment") * self.span + F.col("at")).alias("id"), F.round("bm25", digits).alias("bm25"))
        return top(rows, [F.desc("bm25"), F.asc("id")], k)

    def _searched(self, pairs: list, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
        """query_id, id, bm25 of all that can be among a query's first k: a segment's blocks meet in one task, which holds the k-th scores so far.

        As they rise, more of a query's commonest terms can't lift a document to the k-th by themselves: only the others,
        the essential ones, find candidates, and postings of common terms are read where there are candidates, for their queries.
        """
        spark = queries.sparkSession
        asked = F.broadcast(spark.createDataFrame([(t,) for t in sorted({r.term for r in pairs})], "term string"))  # no more than TERMS
        buckets = [r.bucket for r in asked.select(self._bucket(F.col("term")).alias("bucket")).distinct().collect()]  # no more than there are
        own = self.blocks.where(F.col("bucket").isin(buckets)).join(asked, "term", "left_semi")
        mean, span = max(self.length / max(self.documents, 1), 1e-9), self.span
        gain = F.array_max(F.transform("frontier", lambda x: x["tf"] * (k1 + 1) / (x["tf"] + k1 * (1 - b + b * x["length"] / mean))))
        known = {r.term: r for r in own.groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.max(gain).alias("gain")).collect()}  # no more than the queries have
        names = sorted({r.query_id for r in pairs if r.term in known}, key=lambda x: (x is None, x))
        terms, place = sorted(known), {q: i for i, q in enumerate(names)}
        number, many = {t: i for i, t in enumerate(terms)}, len(names)
        df = np.array([known[t].df for t in terms], np.float64)
        idf = np.log1p((self.documents - df + 0.5) / (df + 0.5))
        most = idf * np.array([known[t].gain for t in terms], np.float64)
        told = np.array([(number[r.term], place[r.query_id]) for r in pairs if r.term in known], np.int64).reshape(-1, 2)
        told = told[np.lexsort((told[:, 0], most[told[:, 0]], told[:, 1]))]  # a query's terms, the least that matters first
        term, query = told[:, 0], told[:, 1]
        so_far = np.cumsum(most[term])
        so_far -= np.concatenate([[0.0], so_far])[np.searchsorted(query, np.arange(many))][query]  # what a term and those before it can give
        vocabulary = pa.array(terms, pa.string())

        def found(t: np.ndarray, n: np.ndarray, at: np.ndarray, weight: np.ndarray, pair: np.ndarray) -> np.ndarray:
            """Scores of a segment's places by query, from the chosen pairs of query and term; blocks t hold n places each."""
            own = pair[np.argsort(term[pair], kind="stable")]
            first = np.searchsorted(term[own], np.arange(len(terms) + 1))
            wide = first[t + 1] - first[t]
            total = np.zeros(span * many)
            ends, cost = np.cumsum(n), np.cumsum(n * wide)
            i = 0
            while i < len(t):
                j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + PAIRS, "right")))
                low, high = ends[i] - n[i], ends[j - 1]
                block = np.repeat(np.arange(i, j), n[i:j])
                each = np.repeat(np.arange(len(block)), wide[block])
                mine = query[own[np.arange(len(each)) - np.repeat(np.cumsum(wide[block]) - wide[block], wide[block]) + first[t[block]][each]]]
                total += np.bincount(at[low:high][each] * many + mine, weight[low:high][each], span * many)
                i = j
            return total.reshape(span, many)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.full((k, many), -np.inf)

            def one(segment: int, blocks: pa.Table) -> pa.RecordBatch:
                nonlocal best
                t = pc.index_in(blocks["term"].combine_chunks(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
                lists = {c: blocks[c].combine_chunks() for c in ("at", "tf", "length", "frontier")}
                n = pc.list_value_length(lists["at"]).to_numpy(zero_copy_only=False).astype(np.int64)
                at, tf, length = (lists[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "tf", "length"))
                worth = lambda t, tf, length: idf[t] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))
                edge, wide = lists["frontier"].flatten(), pc.list_value_length(lists["frontier"]).to_numpy(zero_copy_only=False)
                edge = worth(np.repeat(t, wide), *(edge.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tf", "length")))
                here = np.zeros(len(terms))
                np.maximum.at(here, np.repeat(t, wide), edge)  # the most that a term gives in this segment
                least = np.maximum(best.min(axis=0), 0) - TIE
                essential = so_far >= least[query]
                weight = np.full(len(at), np.nan)

                def read(pair: np.ndarray) -> np.ndarray:
                    chosen = np.isin(t, term[pair])
                    postings = np.repeat(chosen, n)
                    weight[postings] = worth(np.repeat(t[chosen], n[chosen]), tf[postings], length[postings])
                    return found(t[chosen], n[chosen], at[postings], weight[postings], pair)

                total = read(np.nonzero(essential)[0])
                others = np.bincount(query[~essential], here[term[~essential]], many)
                close = (total > 0) & (total + others >= least)
                there = close.any(axis=0)
                rest = np.nonzero(~essential & there[query] & (here[term] > 0))[0]
                if len(rest):
                    total += read(rest)
                close &= total >= least
                best = np.partition(np.vstack([best, np.where(close, total, -np.inf)]), span, axis=0)[-k:]
                close &= total >= best.min(axis=0) - TIE
                i, q = np.nonzero(close)
                return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(segment * span + i.astype(np.int64)), pa.array(total[i, q])], ["number", "id", "bm25"])

            now, held = None, []
            for batch in batches:
                segments = batch.column(0).to_numpy(zero_copy_only=False)
                ends = [*(np.nonzero(np.diff(segments))[0] + 1), len(segments)] if len(segments) else []
                start = 0
                for end in ends:
                    if segments[start] != now and held:
                        yield one(now, pa.Table.from_batches(held))
                        held = []
                    now = int(segments[start])
                    held.append(batch.slice(start, end - start))
                    start = end
            if held:
                yield one(now, pa.Table.from_batches(held))

        kind = queries.schema["query_id"].dataType.simpleString()
        rows = own.select("segment", "term", "at", "tf", "length", "frontier").repartition("segment").sortWithinPartitions("segment")
        told = spark.createDataFrame(list(enumerate(names)), f"number int, query_id {kind}")
        return rows.mapInArrow(search, "number int, id long, bm25 double").join(F.broadcast(told), "number").select("query_id", "id", "bm25")  # a row a query

    def _others(self, known: DataFrame, found: DataFrame) -> DataFrame:
        """query_id, segment, term, df: blocks of terms that aren't essential, where candidates are."""
        return found.select("query_id", "segment").distinct().join(known.where("not essential").select("query_id", "term", "df"), "query_id")

    def read(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """query_id, blocks, read: blocks of a query's terms, and those of which top() reads postings in the end."""
        _, maxima, known, found = self._plan(queries, k, k1, b)
        every = maxima.join(known.select("query_id", "term", "essential"), "term")
        there = self._others(known, found).select("query_id", "segment", "term", F.lit(1).alias("there"))
        rows = every.join(there, ["query_id", "segment", "term"], "left")
        return rows.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum(F.when(F.col("essential") | F.col("there").isNotNull(), 1).otherwise(0)).alias("read"))


def _kept(rows: DataFrame, schema: str) -> DataFrame:
    """Rows written to the shared folder: what comes before isn't made again."""
    path = scratch(rows.sparkSession)
    rows.select([c.split()[0] for c in schema.split(", ")]).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _down(number: str, by: int) -> Column:
    """Whole division that rounds down, below zero too."""
    return F.expr(f"{number} div {by} - int({number} < 0 and {number} % {by} <> 0)")


def _part(span: int, segments: int) -> Column:
    return _down("id", span * segments)


def _checked(k1: float, b: float) -> None:
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b within 0 and 1")


class LexicalIndex:
    """Versions of an index under a path. A version counts once its manifest, written last, is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _manifest(self, version: str | None = None) -> list:
        fs, at = _fs(self.spark, f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        rows = rows if version is None else rows.where(F.col("version") == version)
        last = rows.agg(F.max("build")).first()[0]
        return rows.where(F.col("build") == last).collect() if last else []  # a row for each part

    def write(self, version: str, documents: DataFrame, span: int = SPAN, segments: int = SEGMENTS, buckets: int = BUCKETS) -> list[int]:
        """Write a version of documents (id, document) and return the parts that were written.

        Parts whose documents are those of the version before (whatever its name) are taken from it. Rows without an id
        take no part; rows that share an id are documents whose scores add up; other columns aren't read.
        """
        docs = documents.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("document").cast("string"), F.lit("")).alias("document")).where("id is not null")
        docs = docs.withColumn("part", _part(span, segments))
        now = {r.part: r for r in summed(docs.select("part", row_digest(F.col("id"), F.col("document")).alias("digest")), "part").collect()}  # a row for each part
        before = {r.part: r for r in self._manifest() if (r.span, r.segments, r.buckets) == (span, segments, buckets)}
        changed = sorted(p for p, r in now.items() if p not in before or before[p].digest != r.digest)
        build = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        folder = f"{self.path}/blocks-{build}"
        lengths: dict[int, int] = {}
        if changed:
            own = docs if len(changed) == len(now) else docs.join(F.broadcast(self.spark.createDataFrame([(p,) for p in changed], "part long")), "part", "left_semi")
            with small_batches(self.spark):
                self._blocks(own, span, segments, buckets).write.partitionBy("part", "bucket").parquet(folder)
            sizes = self.spark.read.schema(BLOCK).parquet(folder).groupBy("part").agg(F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length"))
            lengths = {r.part: r.length for r in sizes.collect()}
        rows = [(version, build, p, folder, r.n, lengths.get(p, 0), r.digest, span, segments, buckets) if p in set(changed) else (version, build, p, before[p].folder, r.n, before[p].length, r.digest, span, segments, buckets) for p, r in now.items()]
        rows = rows or [(version, build, None, None, 0, 0, None, span, segments, buckets)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return changed

    def _blocks(self, docs: DataFrame, span: int, segments: int, buckets: int) -> DataFrame:
        def made(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            ids, tf, length = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2))
            words = pa.chunked_array([h[3] for h in held]).unify_dictionaries()
            term, names = np.concatenate([c.indices.to_numpy() for c in words.chunks]).astype(np.int64), words.chunk(0).dictionary
            segment = ids // span
            at = ids - segment * span
            order = np.lexsort((length, tf, at, term, segment))
            ids, tf, length, term, segment, at = (x[order] for x in (ids, tf, length, term, segment, at))
            new = np.concatenate([[True], (term[1:] != term[:-1]) | (segment[1:] != segment[:-1])])
            first = np.nonzero(new)[0]
            block = np.cumsum(new) - 1
            # within a block, by falling frequency, lengths that are below all before them
            by = np.lexsort((length, -tf, block))
            low = length[by] + (len(first) - block[by]) * (length.max() + 1)
            edge = by[np.concatenate([[True], low[1:] < np.minimum.accumulate(low)[:-1]])]
            lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)
            ints = lambda x: pa.array(x.astype(np.int32))
            ends, edges = np.append(first, len(term)), np.append(np.searchsorted(block[edge], np.arange(len(first))), len(edge))
            columns = [pa.array(segment[first]), names.take(pa.array(term[first])), *[lists(ends, ints(x)) for x in (at, tf, length)], lists(edges, pa.StructArray.from_arrays([ints(tf[edge]), ints(length[edge])], ["tf", "length"]))]
            whole = pa.RecordBatch.from_arrays(columns, ["segment", "term", "at", "tf", "length", "frontier"])
            for i in range(0, whole.num_rows, ROWS):
                yield whole.slice(i, ROWS)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                words = pc.dictionary_encode(batch.column(1).flatten())
                if not len(words):
                    continue
                row, many = np.repeat(np.arange(len(size)), size), len(words.dictionary)
                found, tf = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
                row = found // many
                held.append((batch.column(0).to_numpy(zero_copy_only=False)[row], tf, size[row], pa.DictionaryArray.from_arrays(pa.array((found % many).astype(np.int32)), words.dictionary)))
                n += len(found)
                if n > HELD:
                    yield from made(held)
                    held, n = [], 0
            if held:
                yield from made(held)

        docs = docs.withColumn("segment", _down("id", span))
        places = docs.select("segment", F.spark_partition_id().alias("task")).distinct()
        seen = places.agg(F.count("*").alias("n"), F.count_distinct("segment").alias("segments"), F.count_distinct("task").alias("tasks")).first()
        # where ids don't follow the order of reading, documents first go to their segments, so that blocks stay whole
        docs = docs.repartition("segment") if seen.n > 2 * (seen.segments + seen.tasks) else docs
        b = docs.select("id", tx.tokens(F.col("document")).alias("t")).mapInArrow(counted, ", ".join(c for c in BLOCK.split(", ") if c.split()[0] not in ("part", "bucket")))
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        rows = b.withColumns({"part": _down("segment", segments), "bucket": bucket}).select("part", "bucket", "segment", "term", "at", "tf", "length", "frontier")
        return rows.sortWithinPartitions("part", "bucket", "term", "segment")

    def open(self, version: str) -> Snapshot:
        """A version as it was last written; versions written later don't change it."""
        rows = self._manifest(version)
        if not rows:
            raise ValueError(f"version {version} isn't there")
        folders: dict[str, list[int]] = {}
        for r in rows:
            if r.length:
                folders.setdefault(r.folder, []).append(r.part)
        blocks = self.spark.createDataFrame([], BLOCK)
        for i, (folder, parts) in enumerate(folders.items()):
            own = self.spark.read.schema(BLOCK).parquet(folder).select([c.split()[0] for c in BLOCK.split(", ")]).where(F.col("part").isin(parts))
            blocks = own if not i else blocks.unionByName(own)
        return Snapshot(blocks, sum(r.documents for r in rows), sum(r.length for r in rows), rows[0].span, rows[0].buckets)
