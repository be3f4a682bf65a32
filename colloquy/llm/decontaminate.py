"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces: in any text within k edits, one piece
is there unchanged. One automaton finds the pieces of all items in a document. A hit is verified with
Myers's bit-parallel distance, first over pairs of pieces, then over fours and so on up to the whole
item: a part of m pieces may hold m - 1 edits, which the same argument allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

#: Edits allowed, as a share of an item's characters.
ERRORS = 0.1
#: Items and their characters that one block holds: the bound of what goes to each task. More items take more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000


def normal(text: str | None) -> str:
    """Lower case, single spaces; null counts as empty."""
    return " ".join((text or "").lower().split())


class Pattern:
    """A part of an item for Myers's search."""

    __slots__ = ("peq", "size")

    def __init__(self, part: str) -> None:
        self.size, self.peq = len(part), {}
        for i, c in enumerate(part):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def search(self, text: str) -> tuple[int, int]:
        """The least distance of the part to any substring of text, and where the first such substring ends."""
        mask, top = (1 << self.size) - 1, 1 << (self.size - 1)
        pv, mv, score, get = mask, 0, self.size, self.peq.get
        best, end = score, 0
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, at
            ph, mh = ph << 1 & mask, mh << 1 & mask
            pv, mv = mh | ~(xv | ph) & mask, ph & xv
        return best, end


class Matcher:
    """Finds items in documents; items: (id, text), null or blank texts take no part."""

    def __init__(self, items: tuple[tuple[int, str], ...], errors: float) -> None:
        self.items = [(i, t) for i, raw in items if (t := normal(raw))]
        self.cuts: list[list[int]] = []
        self.patterns: dict[tuple[int, int, int], Pattern] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            k = int(len(t) * errors)
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            self.cuts.append(cuts)
            for j in range(k + 1):
                pieces.setdefault(t[cuts[j] : cuts[j + 1]], []).append((n, j))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def verify(self, text: str, n: int, j: int, at: int) -> tuple[int, int] | None:
        """Distance and end of item n, given its piece j at a place of text; None if over its budget."""
        cuts, item = self.cuts[n], self.items[n][1]
        pieces, span, got = len(cuts) - 1, 1, (0, at + cuts[j + 1] - cuts[j])
        low, high = j, j + 1
        while (low, high) != (0, pieces):
            span *= 2
            a, b = j // span * span, min(j // span * span + span, pieces)
            if (a, b) == (low, high):
                continue
            low, high = a, b
            budget = high - low - 1
            pattern = self.patterns.get((n, low, high))
            if pattern is None:
                pattern = self.patterns[n, low, high] = Pattern(item[cuts[low] : cuts[high]])
            first = max(0, at - (cuts[j] - cuts[low]) - budget)
            best, end = pattern.search(text[first : at + cuts[high] - cuts[j] + budget])
            if best > budget:
                return None
            got = best, first + end
        return got

    def find(self, raw: str | None) -> dict[int, tuple[int, int]]:
        """By item number: the least distance in the whole text, and where that passage ends in the normalised text."""
        text = normal(raw)
        found: dict[int, tuple[int, int]] = {}
        if not self.items or not text:
            return found
        tried: set[tuple[int, int]] = set()
        for last, (size, where) in self.automaton.iter(text):
            at = last - size + 1
            for n, j in where:
                old = found.get(n)
                if old and not old[0]:
                    continue
                cuts = self.cuts[n]
                start = at - cuts[j]
                if start >= 0 and text.startswith(self.items[n][1], start):
                    found[n] = 0, start + cuts[-1]
                    continue
                if (n, start, j) in tried:
                    continue
                tried.add((n, start, j))
                got = self.verify(text, n, j, at)
                if got and (old is None or got < old):
                    found[n] = got
        return found


@lru_cache(maxsize=2)
def matcher(items: tuple[tuple[int, str], ...], errors: float) -> Matcher:
    return Matcher(items, errors)


def blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items, in blocks of bounded size; rows without an id or a text take no part."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, ceil(n / BLOCK_ITEMS), ceil(chars / BLOCK_CHARS)) if n else 0
    for k in range(parts):
        yield tuple(sorted((r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()))


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """doc_id, item_id, distance, passage_end for each row of docs and each item within its budget there.

    The distance counts edits of characters after lower-casing and joining white space; an item's budget is
    that share of its length, rounded down. Whole texts are read, null as empty; repeated rows of docs are
    each reported, repeated item ids once with their nearest text. Other columns are not read; an empty table or
    an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, passage_end long"
    out = spark.createDataFrame([], schema)
    for items in blocks(benchmark):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            m = matcher(shipped.value, errors)
            for b in batches:
                got = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    best: dict[int, tuple[int, int]] = {}
                    for n, hit in m.find(text).items():
                        best[m.items[n][0]] = min(hit, best.get(m.items[n][0], hit))
                    got += [(doc_id, item, *hit) for item, hit in sorted(best.items())]
                cols = list(zip(*got, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "passage_end"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """The rows of docs, all columns, in whose text no item is within its budget; null and empty texts hold none.

    Repeated rows all stay or all go; an empty benchmark drops none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at, schema = docs.columns.index("text"), docs.schema
    for items in blocks(benchmark):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            m = matcher(shipped.value, errors)
            for b in batches:
                yield b.filter(pa.array([not m.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
