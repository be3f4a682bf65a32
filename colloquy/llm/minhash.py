"""Near duplicates by fast similarity sketching: sketches in rounds, banding, exact verification.

A sketch has T coordinates. In each of the first T rounds every shingle is hashed into one coordinate and leaves
a value there if it is the least of the first round that reaches the coordinate; long texts need one round, short ones
some more. In the last T rounds each shingle goes to the one coordinate of that round, so every coordinate fills. Two
sketches agree at a coordinate with the similarity of their sets as chance, and the agreements concentrate as those of
independent hashes would.

BANDS bands of ROWS coordinates each are keys. Sets with a similarity of 0.85 share none of them with a chance of
1.3e-10. Sets that share a key, or a chain of keys, are one group of candidates; the sets themselves, in full, decide
which are linked. In a group, what is linked to a leader is settled in one pass, and only the rest is compared with
others by counting shared shingles, so a large group of near copies costs as much as its sets. A group larger
than a part is cut: each part meets the group's leader, and then only what isn't linked to that leader meets all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, small_batches
from .simhash import roots, shingles

SHINGLE = 3
#: Linked are sets with LEAST[0] of LEAST[1] of their union in common, at least.
LEAST = (85, 100)
BANDS, ROWS = 48, 6
T = BANDS * ROWS
#: Sets, and shingles, in a part of a group of candidates at most (a single larger set is a part of its own).
SETS, ELEMENTS = 1_000, 4_000_000
#: Leaders that a part's sets are compared with before the rest is counted.
LEADERS = 4

NONE = np.zeros(0, np.uint64)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_ROUND = _mixed(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(elements: np.ndarray) -> np.ndarray:
    """T values: the round (10 bits) in which a coordinate was reached first, and the least hash there in that round; free if there are no elements."""
    out, n, at = np.full(T, _FREE), len(elements), 0
    while n and at < T and (out == _FREE).any():
        rounds = min(T - at, -(-8 * T // n))  # several at once: later ones don't touch what earlier ones have filled
        x = _mixed(elements[None, :] ^ _ROUND[at : at + rounds, None])
        place = (x >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)
        value = np.arange(at, at + rounds, dtype=np.uint64)[:, None] << np.uint64(54) | _mixed(x) >> np.uint64(10)
        np.minimum.at(out, place.ravel().astype(np.intp), value.ravel())
        at += rounds
    for free in np.flatnonzero(out == _FREE).tolist() if n else []:
        out[free] = np.uint64(T + free) << np.uint64(54) | _mixed(_mixed(elements ^ _ROUND[T + free])).min() >> np.uint64(10)
    return out


def keys(values: np.ndarray) -> np.ndarray:
    """A sketch's BANDS keys, as signed longs."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in values.reshape(BANDS, ROWS).T:
        out = _mixed(out ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


class Index:
    """Which sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets) if sets else NONE
        order = np.argsort(flat, kind="stable")
        self.terms, self.owner, self.n = flat[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], len(sets)

    def overlaps(self, own: np.ndarray) -> np.ndarray:
        """How many elements each set shares with own."""
        out = np.zeros(self.n, np.int64)
        low, high = np.searchsorted(self.terms, own, "left"), np.searchsorted(self.terms, own, "right")
        for at in range(0, len(own), 4096):
            start, number = low[at : at + 4096], (high - low)[at : at + 4096]
            ends = np.cumsum(number)
            if ends[-1]:
                out += np.bincount(self.owner[np.repeat(start - ends + number, number) + np.arange(ends[-1])], minlength=self.n)
        return out


def _linked(both: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    least, of = LEAST
    return (least + of) * both >= least * (size + sizes)


def within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the same sets (sorted, without repeats) as all links do; the first set is the first leader."""
    n = len(sets)
    if n == 2:
        both = np.count_nonzero(np.isin(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if _linked(both, len(sets[0]), len(sets[1])) else []
    sizes, label, out = np.array([len(x) for x in sets], np.int64), np.arange(n), []
    flat, starts = np.concatenate([*sets, NONE]), np.concatenate(([0], np.cumsum(sizes)))
    free = np.ones(n, bool)
    for _ in range(LEADERS):  # stars: each takes what is linked to it
        if not free.any():
            break
        leader = int(np.argmax(free))
        both = np.diff(np.concatenate(([0], np.cumsum(np.isin(flat, sets[leader]))))[starts])
        near = np.flatnonzero(_linked(both, sizes[leader], sizes) & free)
        out += [(leader, x) for x in near.tolist() if x != leader]
        label[near], free[near], free[leader] = leader, False, False
    names, counts = np.unique(label, return_counts=True)
    main = names[np.argmax(counts)]
    if len(names) > 1:
        out += _crossing(sets, np.flatnonzero(label != main).tolist(), sets, label, label[:])
    return out


def _crossing(left: list[np.ndarray], chosen: list[int], right: list[np.ndarray], left_label: np.ndarray, right_label: np.ndarray) -> list[tuple[int, int]]:
    """Links x, y between the chosen of left and right that join what labels don't; both label arrays change together."""
    index, sizes, out = Index(right), np.array([len(x) for x in right], np.int64), []
    for x in chosen:
        for y in np.flatnonzero(_linked(index.overlaps(left[x]), len(left[x]), sizes) & (right_label != left_label[x])).tolist():
            was, now = right_label[y], left_label[x]
            if was != now:
                left_label[left_label == was] = now
                right_label[right_label == was] = now
                out.append((x, y))
    return out


def between(part: list[np.ndarray], part_label: np.ndarray, rest: list[np.ndarray], rest_label: np.ndarray) -> list[tuple[int, int]]:
    """Links x, y between rest and part that join different labels."""
    return _crossing(rest, list(range(len(rest))), part, rest_label.copy(), part_label.copy())


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the set), n (its size), keys (none for sets that are too small to be linked with another)."""
    least, of = LEAST
    smallest = -(-least // (of - least))  # sets of fewer elements reach the similarity with an equal set only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t, SHINGLE)) for t in b.column(1).to_pylist()]
            bands = [keys(sketch(x)) if len(x) >= smallest else [] for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """node, root: groups of sets (node, keys) that chains of shared keys join."""
    rows = classes.select("node", F.explode("keys").alias("key"))
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head")
    return roots(rows.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))


def _compared(tasks: DataFrame) -> DataFrame:
    """Links a, b of tasks (root, i, j): rows of side 0 are a part, those of side 1 (if any) the rest that meets it; label: what is joined already."""
    dealt = tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "place", "node")

    def close(held: tuple[list, list]) -> list[tuple[int, int]]:
        part, rest = held
        if not rest:
            return [(part[x][0], part[y][0]) for x, y in (within([s for _, _, s in part]) if len(part) > 1 else [])]
        found = between([s for _, _, s in part], np.array([c for _, c, _ in part]), [s for _, _, s in rest], np.array([c for _, c, _ in rest]))
        return [(rest[x][0], part[y][0]) for x, y in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])
        for b in batches:
            out: list[tuple[int, int]] = []
            for root, i, j, side, node, label, own in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (root, i, j) != key:
                    out += close(held)
                    key, held = (root, i, j), ([], [])
                held[side].append((node, label, np.frombuffer(own, np.uint64)))
            yield _pairs(out)
        yield _pairs(close(held))

    return dealt.select("root", "i", "j", "side", "node", "label", "own").mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def verified(docs: DataFrame, groups: DataFrame, part: int = SETS, elements: int = ELEMENTS) -> DataFrame:
    """node, root: what the links between sets of one group (node, n, root) join, by their full sets."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, SHINGLE)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "own"])

    def sets(wanted: DataFrame) -> DataFrame:
        return _texts(docs).join(wanted.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(whole, "node long, own binary").distinct()

    parts = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum("n") / elements)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every: Column = F.sequence(F.lit(0), F.col("parts") - 1)
    cut = materialize(groups.join(parts, "root").select("node", "root", "parts", own.alias("own")), "parts")
    # the group's root leads each of its parts
    first = cut.select("node", "root", F.explode(F.when(F.col("node") == F.col("root"), every).otherwise(F.array("own"))).alias("i"))
    first = first.select("node", "root", "i", F.lit(0).alias("j"), F.lit(0).alias("side"), (F.col("node") != F.col("root")).cast("int").alias("place"), F.col("node").alias("label"))
    near = materialize(_compared(first.join(sets(cut), "node")), "near")
    joined = roots(near)
    large = cut.where("parts > 1")
    if large.isEmpty():
        return joined
    named = materialize(large.join(joined.withColumnRenamed("root", "found"), "node", "left").select("node", "root", "parts", "own", F.coalesce("found", "node").alias("label")), "named")
    lead = named.where("node = root").select("root", F.col("label").alias("main"))
    rest = materialize(named.join(lead, "root").where("label <> main").drop("main"), "rest")
    chunks = rest.groupBy("root").agg(F.ceil(F.count("*") / part).cast("int").alias("chunks"))
    meets = rest.join(chunks, "root").select("node", "root", F.explode(every).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int").alias("j"), F.lit(1).alias("side"), F.lit(0).alias("place"), "label")
    there = named.join(chunks, "root").select("node", "root", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(0).alias("side"), F.lit(0).alias("place"), "label")
    tasks = meets.unionByName(there)
    return roots(near.unionByName(_compared(tasks.join(sets(tasks), "node"))))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: sets of three-word shingles, linked from 85 of 100 of their union.

    component_id is the least doc_id that links reach. Null and empty texts and those without words have no shingle and
    no link; of fewer than three words, all together are one shingle. Rows that share a doc_id are one document, linked
    with what any of their texts is linked with; each has its own n_shingles. Rows of a null doc_id are linked with
    nothing: their component_id is null and they are kept. Other columns aren't read; an empty table gives no rows.
    """
    signed = materialize(signatures(docs), "signatures")
    named = signed.where("doc_id is not null")
    classes = materialize(named.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")), "classes")
    found = candidates(classes)
    found = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    sizes = classes.groupBy("node").agg(F.max("n").alias("n"))
    groups = materialize(found.join(sizes, "node"), "groups")
    several = named.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x <> y").select("doc_id")
    again = named.where("n > 0").join(several, "doc_id", "left_semi").join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    linked = verified(docs, groups).select(F.col("node").alias("a"), F.col("root").alias("b"))
    ends = materialize(roots(linked.unionByName(again)), "ends")
    tops = classes.select("digest", "node").join(ends, "node", "left").select("digest", F.coalesce("root", "node").alias("top"))
    with_text = named.where("n > 0").select("doc_id", "n", "digest").join(tops, "digest").select("doc_id", "n", "top")
    without = named.where("n = 0").select("doc_id", "n").join(ends.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("top"))
    nameless = signed.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("top"))
    rows = with_text.unionByName(without).unionByName(nameless)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("top").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"))
