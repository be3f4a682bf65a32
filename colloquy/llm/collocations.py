"""Phrases whose words stand together more often than their parts: bounded suffix automata over shards of words.

A task cuts its texts into shards of one language. A shard's generalised suffix automaton, bounded in depth, is built
level by level: the phrases of a length that end at the same words form a state, its suffix link is the state of the
phrase without its first word, and `before` that of the phrase without its last, from which the transition comes.
A state's count is the number of its end positions. Building it this way is sorting pairs of numbers, so numpy does it.

Counts meet by a digest of 96 bits. A shard sends its digests as packed blocks, one for each range of digests, and a
task adds up a range over all shards. What is frequent goes back to the shards that hold it. A longer phrase is never
more frequent than a part of it, so a shard grows its automaton only where both shorter phrases are frequent over all
data: that leaves out most phrases of three and four words and no frequent one. One shard of those that hold
a frequent phrase writes it down as text, with its cuts and the phrases inside it, found by links; scores, subsumption
and ranks are joins of the frequent phrases alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, small_batches

#: Words of a phrase at most, and its least count.
DEPTH, LEAST = 4, 30
#: A phrase inside a longer one that has this share (of 100) of its occurrences goes.
INSIDE = 80
#: Phrases returned of a language.
TOP = 2_000
#: Words in a shard, if no single text is longer. Ranges of digests are at least so many, and one for each shard's worth of words.
SHARD, RANGES = 1 << 21, 512
#: Groups in which a language's phrases are ranked first.
SALTS = 32

_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
_MIX = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)))
_DIGEST = np.dtype([("a", "<u8"), ("b", "<u4")])


def tokens(text: str | None, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a whole text in parts of about `step` bytes; b"." stands between pieces, which end at .,;:!? and line ends."""
    raw = (text or "").encode("utf-8", "replace").lower().translate(_ENDS).replace(b".", b" . ")
    at = 0
    while at < len(raw):
        end = next((e for e in (raw.find(b" ", at + step),) if e >= 0), len(raw))
        yield raw[at:end].split()
        at = end


class Automaton:
    """The states of a shard's phrases by length, from 1 up; ids: a word's number, or -1 between pieces and texts."""

    def __init__(self, ids: np.ndarray, words: list[bytes]) -> None:
        self.ids, self.words, n = ids, words, len(words)
        places = np.arange(len(ids))
        self.depth = places - np.maximum.accumulate(np.where(ids < 0, places, -1)) if len(ids) else places
        real = places[ids >= 0]
        end = np.zeros(n, np.int64)
        end[ids[real][::-1]] = real[::-1]
        digests = [xxhash.xxh3_128_intdigest(w) for w in words]
        lanes = [np.array([d >> 64 * i & 0xFFFFFFFFFFFFFFFF for d in digests], np.uint64) for i in (0, 1)]
        self.end, self.count, self.lanes = [end], [np.bincount(ids[real], minlength=n)], [lanes]
        self.link = [np.full(n, -1, np.int32)]
        self.before = [self.link[0]]
        self.state = ids  # of the longest phrases that end at each place so far; -1: none

    def grow(self, ok: np.ndarray | None = None) -> None:
        """Add phrases one word longer, of which both the link and `before` are ok (all, by default)."""
        length, n = len(self.count) + 1, len(self.words)
        good = np.append(np.ones(len(self.count[-1]), bool) if ok is None else ok, False)
        ends = np.flatnonzero(self.depth >= length)
        ends = ends[good[self.state[ends]] & good[self.state[ends - 1]]]
        key = self.state[ends].astype(np.int64) * n + self.ids[ends - length + 1]
        found, at, inverse, number = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        link, first = (found // max(n, 1)).astype(np.int32), found % max(n, 1)
        lanes = []
        for i, (c, d) in enumerate(_MIX):
            x = self.lanes[-1][i][link]
            x = (x ^ x >> np.uint64(29)) * c + self.lanes[0][i][first] * np.uint64(2 * length + 1)
            lanes.append((x ^ x >> np.uint64(32)) * d)
        self.lanes.append(lanes)
        self.count.append(number)
        self.link.append(link)
        self.end.append(ends[at])
        self.before.append(self.state[self.end[-1] - 1])
        self.state = np.full(len(self.ids), -1, np.int32)
        self.state[ends] = inverse

    def text(self, length: int, state: int) -> str:
        end = int(self.end[length - 1][state])
        return b" ".join([self.words[i] for i in self.ids[end - length + 1 : end + 1].tolist()]).decode("utf-8", "replace")

    def inner(self, length: int, state: int, first: int, last: int) -> tuple[int, int]:
        """Length and state of a phrase without `first` words at its start and `last` words at its end."""
        for _ in range(last):
            length, state = length - 1, int(self.before[length - 1][state])
        for _ in range(first):
            length, state = length - 1, int(self.link[length - 1][state])
        return length, state

    def listed(self, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests and counts of all phrases of some lengths in order of digests, and each one's place among these lengths' states."""
        a, b = (np.concatenate([self.lanes[x - 1][i] for x in lengths]) for i in (0, 1))
        order = np.argsort(a, kind="stable")
        out = np.empty(len(a), _DIGEST)
        out["a"], out["b"] = a[order], (b[order] >> np.uint64(32)).astype(np.uint32)
        return out, np.concatenate([self.count[x - 1] for x in lengths])[order], order


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, lang, words (their number), body (compressed): the words of all texts, by language."""

    def close(lang: str, held: tuple) -> pa.RecordBatch:
        known, parts = held
        close.n += 1
        ids = np.concatenate(parts)
        words = b"\n".join(w for w in known if w != b".")
        body = zstandard.compress(len(words).to_bytes(8, "little") + words + ids.tobytes(), 1)
        shard = (TaskContext.get().partitionId() << 32) + close.n
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "lang": pa.array([lang]), "words": pa.array([int((ids >= 0).sum())], pa.int64()), "body": pa.array([body], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close.n = 0
        open_: dict[str, tuple] = {}
        sizes: dict[str, int] = defaultdict(int)
        gap = np.array([-1], np.int32)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in open_:
                    known: defaultdict[bytes, int] = defaultdict(count(-1).__next__)
                    known[b"."]
                    open_[lang] = known, []
                known, parts = open_[lang]
                for part in tokens(text):
                    ids = np.fromiter(map(known.__getitem__, part), np.int32, len(part))
                    parts.append(ids)
                    sizes[lang] += len(ids)
                parts.append(gap)
            while sum(sizes.values()) > size:
                lang = max(sizes, key=sizes.__getitem__)
                sizes.pop(lang)
                yield close(lang, open_.pop(lang))
        for lang, held in open_.items():
            yield close(lang, held)

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "shard long, lang string, words long, body binary")


def automaton(body: bytes) -> Automaton:
    raw = zstandard.decompress(body)
    n = int.from_bytes(raw[:8], "little")
    words = raw[8 : 8 + n].split(b"\n") if n else []
    return Automaton(np.frombuffer(raw[8 + n :], np.int32), words)


def _blocks(lang: str, shard: int, a: Automaton, lengths: tuple[int, ...], bits: int) -> pa.RecordBatch:
    """A shard's phrases of some lengths as packed blocks, one for each range of digests."""
    digests, counts, _ = a.listed(lengths)
    ranges, starts = np.unique(digests["a"] >> np.uint64(64 - bits), return_index=True)
    ends = [*starts[1:].tolist(), len(digests)]
    cut = list(zip(starts.tolist(), ends, strict=True)) if len(digests) else []
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang] * len(cut), pa.string()), "range": pa.array(ranges.astype(np.int32)), "shard": pa.array([shard] * len(cut), pa.int64()), "start": pa.array([s for s, _ in cut], pa.int64()),
        "digests": pa.array([digests[s:e].tobytes() for s, e in cut], pa.binary()), "counts": pa.array([counts[s:e].astype("<u4").tobytes() for s, e in cut], pa.binary()),
    })


BLOCKS = "lang string, range int, shard long, start long, digests binary, counts binary"


def frequent(blocks: DataFrame, least: int = LEAST) -> DataFrame:
    """shard, found, own, totals: the places (u4, as the shard lists them) of its frequent phrases, and those it is to write down with their counts (i8)."""

    def close(shards: list[int], starts: list[int], digests: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple]:
        all_, number = np.concatenate(digests), np.concatenate(counts).astype(np.int64)
        order = np.argsort(all_["a"], kind="stable")
        a, b = all_["a"][order], all_["b"][order]
        if (b[1:] != b[:-1])[a[1:] == a[:-1]].any():
            order = np.lexsort((all_["b"], all_["a"]))
            a, b = all_["a"][order], all_["b"][order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        heads = np.flatnonzero(new)
        sums = np.add.reduceat(number[order], heads)
        group = np.cumsum(new) - 1
        often = (sums >= least)[group]
        total = np.zeros(len(order), np.int64)
        total[order] = sums[group]
        keep, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
        keep[order] = often
        first[order[heads]] = True
        out, at = [], 0
        for shard, start, own in zip(shards, starts, digests, strict=True):
            here = np.flatnonzero(keep[at : at + len(own)])
            if len(here):
                mine = here[first[at + here]]
                out.append((shard, (here + start).astype("<u4").tobytes(), (mine + start).astype("<u4").tobytes(), total[at + mine].astype("<i8").tobytes()))
            at += len(own)
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(4)], ["shard", "found", "own", "totals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        for b in batches:
            out = []
            for lang, at, shard, start, digests, counts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (lang, at) != key:
                    out += close(*held) if key else []
                    key, held = (lang, at), ([], [], [], [])
                for x, into in zip((shard, start, np.frombuffer(digests, _DIGEST), np.frombuffer(counts, "<u4")), held, strict=True):
                    into.append(x)
            yield batch(out)
        yield batch(close(*held) if key else [])

    return blocks.repartition("lang", "range").sortWithinPartitions("lang", "range", "shard").mapInArrow(run, "shard long, found binary, own binary, totals binary")


def answered(table: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """The shards, with what was sent back to each as an array."""
    lists = replies.groupBy("shard").agg(F.collect_list(F.struct("found", "own", "totals")).alias(name))
    return table.join(lists, "shard", "left")


def _marked(replies: list[dict] | None, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for r in replies or []:
        out[np.frombuffer(r["found"], "<u4")] = True
    return out


def _grown(body: bytes, replies: list[dict] | None) -> Automaton:
    """A shard's automaton at full depth; from three words on, of phrases whose parts are frequent."""
    a = automaton(body)
    a.grow()
    _, _, order = a.listed((1, 2))
    ok = np.zeros(len(order), bool)
    ok[order] = _marked(replies, len(order))
    a.grow(ok[len(a.count[0]) :])
    for _ in range(DEPTH - 3):
        a.grow()
    return a


def phrases(docs: DataFrame, size: int = SHARD, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases: lang, phrase, size (words), f, cuts (k, first, rest), inside (shorter phrases of two words or more); and lang, n.

    Both are written to the shared folder.
    """
    spark = docs.sparkSession
    table = materialize(shards(docs, size), "shards")
    total = table.agg(F.sum("words")).first()[0] or 0
    bits = max(ranges, total // size).bit_length()
    longer = tuple(range(3, DEPTH + 1))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, lang, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                a = automaton(body)
                a.grow()
                yield _blocks(lang, shard, a, (1, 2), bits)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, lang, body, replies in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                yield _blocks(lang, shard, _grown(body, replies), longer, bits)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, body, *replies in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                a = _grown(body, replies[0])
                out: list[tuple] = []
                for lengths, sent in (((1, 2), replies[0]), (longer, replies[1])):
                    _, _, order = a.listed(lengths)
                    edges = np.cumsum([0, *(len(a.count[x - 1]) for x in lengths)])
                    for r in sent or []:
                        places = order[np.frombuffer(r["own"], "<u4")]
                        which = np.searchsorted(edges, places, "right") - 1
                        for i, state, f in zip(which.tolist(), (places - edges[which]).tolist(), np.frombuffer(r["totals"], "<i8").tolist(), strict=True):
                            n = lengths[i]
                            part = lambda first, last, n=n, state=state: a.text(*a.inner(n, state, first, last))
                            cuts = [{"k": k, "first": part(0, n - k), "rest": part(k, 0)} for k in range(1, n)]
                            out.append((lang, a.text(n, state), n, f, cuts, sorted({part(x, y) for x in range(n) for y in range(n - x) if 2 <= n - x - y < n})))
                for at in range(0, len(out), 10_000):
                    rows = list(zip(*out[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types, strict=True)], ["lang", "phrase", "size", "f", "cuts", "inside"])

    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.struct([("k", pa.int32()), ("first", pa.string()), ("rest", pa.string())])), pa.list_(pa.string())]
    small_batches(spark, 16)
    common = materialize(frequent(table.select("shard", "lang", "body").mapInArrow(short, BLOCKS)), "common")
    once = answered(table.select("shard", "lang", "body"), common, "short")
    found = materialize(frequent(once.select("shard", "lang", "body", "short").mapInArrow(long, BLOCKS)), "found")
    twice = answered(once, found, "long").select("lang", "body", "short", "long")
    schema = "lang string, phrase string, size int, f long, cuts array<struct<k:int,first:string,rest:string>>, inside array<string>"
    return materialize(twice.mapInArrow(told, schema), "phrases"), table.groupBy("lang").agg(F.sum("words").alias("n"))


def collocations(docs: DataFrame, top: int = TOP, size: int = SHARD, ranges: int = RANGES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, then count, then bytes.

    A phrase of 2 to 4 words that occurs LEAST times or more is cut in two where its score, 2,000,000 a / (l + r), is
    lowest (the first such cut); it goes if a longer such phrase that holds it has INSIDE of 100 of its occurrences.
    Letters A-Z count as small ones, phrases end at .,;:!? and line ends. A null lang is `und`, a null or empty text has
    no words, a repeated row counts as often as it is there, other columns aren't read, an empty table gives no rows.
    """
    found, sums = phrases(docs, size, ranges)
    counts = found.select("lang", "phrase", "f")
    cuts = found.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), F.explode("cuts").alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.select("lang", "phrase", "a", F.struct(F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)").alias("score"), "k", "l", "r").alias("s"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))
    longer = found.where("size >= 3").select("lang", F.explode("inside").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longest is null or 100 * cast(longest as decimal(20,0)) < {INSIDE} * cast(a as decimal(20,0))"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
