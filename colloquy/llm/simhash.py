"""Near duplicates by SimHash: fingerprints, BK-trees within shards, linked components.

A fingerprint's shard keys are chosen so that what is near shares one. With 64 bits and a radius of three,
the four 16-bit blocks will do: two such fingerprints agree on one of them, so no link is lost. Where there are so
many fingerprints that such shards are large, keys are of two blocks of five or of three of six, which lose none
either, and shards stay small at any number of fingerprints. Near copies are
texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and their keys are shingles: in
any one order of all shingles, two such sets share one of the first fifth of either (prefix filter), at any number
of texts. Shingles that many texts hold come last in that order, so they are keys of few. Fingerprints of 256 bits
within a wide radius leave candidates, and the sets themselves decide which of these are linked.

A shard's BK-tree (children keyed by their integer Hamming distance to the parent) gives the links in it. The
tree holds leaders; what lies within half the radius of a leader is linked to it and kept beside it, so a large
group of copies costs no more than its leaders. A large shard is cut into parts and each pair of parts is a
task of its own; every task returns a spanning forest of its links, so what moves on is never more than the
fingerprints. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, remove, small_batches, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Blocks that a key may be made of; more make keys rarer and their number larger.
SAME = (1, 2, 3)
#: For near copies: words of a shingle, and 64-bit lanes.
NEAR_SHINGLE, LANES = 5, 4
#: Near copies have this Jaccard similarity at least. Candidates lie within so many of 256 bits: 39 are expected at 0.8, 48 in the shortest texts, and 80 is five deviations more.
SIMILAR, CANDIDATE_RADIUS = (4, 5), 80
#: Distinct fingerprints in a shard's part at most.
PART = 2_000
#: Shingle sets in a part of a group of candidates at most.
SETS = 1_000
#: Common shingles that come last in the order of keys, the commonest: the bound of what goes to each task. Any order loses no link.
COMMON = 200_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, lanes: int = 1) -> int:
    """SimHash of a whole text; 0 without words, null too. Further lanes of 64 bits come from mixed hashes."""
    return _signs(shingles(text, shingle), lanes)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in order; of all its words if these are fewer, none without words."""
    raw = (text or "").encode("utf-8", "replace").lower()  # bytes: only A-Z changes, only ASCII space splits
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([hash_of(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    return np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def _signs(h: np.ndarray, lanes: int) -> int:
    """SimHash of hashes; 0 of none."""
    out = 0
    for lane in range(lanes):
        mixed = h if not lane else (h ^ h >> np.uint64(29)) * _MIX[lane - 1]
        mixed = mixed if not lane else mixed ^ mixed >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 32_768):
            ones += np.unpackbits(mixed[at : at + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out |= int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]) << 64 * lane
    return out


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row; null texts count as empty, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fp)})

    return _texts(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints by Hamming distance to the parent."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if not self.nodes:
            self.nodes, self.children = [x], [{}]
            return
        at = 0
        while d := (self.nodes[at] ^ x).bit_count():
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.nodes)
                self.nodes.append(x)
                self.children.append({})
                return
            at = below

    def within(self, x: int, radius: int) -> Iterator[tuple[int, int]]:
        """Those at most radius bits from x, and how far."""
        open_ = [0] if self.nodes else []
        while open_:
            at = open_.pop()
            d = (self.nodes[at] ^ x).bit_count()
            if d <= radius:
                yield self.nodes[at], d
            below = self.children[at]
            if len(below) <= 2 * radius + 1:
                open_ += [c for k, c in below.items() if d - radius <= k <= d + radius]
            else:
                open_ += [below[k] for k in range(d - radius, d + radius + 1) if k in below]


def forest(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within left, or of those between left and right.

    Between two parts, a link within one of them may stand in for others: it is a link as well.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    out: list[tuple[int, int]] = []

    def link(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((x, y))

    tree, half = BKTree(), radius // 2
    beside: dict[int, list[int]] = {}  # what stands with each leader; a leader and these are one component
    for x in left if right is None else left + right:
        home, other = None, []
        for leader, d in tree.within(x, radius + half):
            if d <= half and home is None:
                home = leader
                link(leader, x)
            elif d <= radius:
                link(leader, x)
            else:
                other.append(leader)
        for leader in other:
            if root(leader) != root(x):
                near = next((y for y in beside[leader] if (x ^ y).bit_count() <= radius), None)
                if near is not None:
                    link(near, x)
        if home is None:
            tree.add(x)
            beside[x] = []
        else:
            beside[home].append(x)
    return out


def links(rows: DataFrame, radius: int, part: int = PART, classes: DataFrame | None = None) -> DataFrame:
    """Links a, b between nodes whose fingerprints are within the radius and share a key.

    rows: node (long), block and value, that is a key. classes: node and fp (binary); without it, nodes are
    fingerprints of 64 bits themselves. Fingerprints move only with the rows of keys that nodes share.
    """
    large = rows.groupBy("block", "value").count().where(F.col("count") > 1).select("block", "value", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tasks = rows.join(large, ["block", "value"]).select("node", "block", "value", own.alias("own"), other)
    tasks = tasks.withColumn("fp", F.col("node")) if classes is None else tasks.join(classes.select("node", "fp"), "node")
    tasks = tasks.select("node", "fp", "block", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    keys = ["block", "value", "i", "j"]
    # many shards are of a few rows: a partition's rows, sorted, hold whole shards one after the other
    dealt = tasks.repartition(*keys).sortWithinPartitions(*keys, "own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right, names = None, [], [], {}

        def close() -> list[tuple[int, int]]:
            if key is None or len(left) + len(right) < 2:
                return []
            pairs = forest(left, None if key[2] == key[3] else right, radius)
            out = [(names[a][0], names[b][0]) for a, b in pairs]
            return out + [(same[0], n) for same in names.values() for n in same[1:]]

        for b in batches:
            out: list[tuple[int, int]] = []
            node, fps, block, value, i, j, own = (b.column(k).to_pylist() for k in range(7))
            for n, fp, *at, o in zip(node, fps, block, value, i, j, own, strict=True):
                if at != key:
                    out += close()
                    key, left, right, names = at, [], [], {}
                x = int.from_bytes(fp, "little") if isinstance(fp, bytes) else fp & 0xFFFFFFFFFFFFFFFF
                if x in names:
                    names[x].append(n)
                else:
                    names[x] = [n]
                    (left if o == at[2] else right).append(x)
            yield _edges(out)
        yield _edges(close())

    return dealt.mapInArrow(run, "a long, b long")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the least node that links reach) for each node in edges a, b: alternating large and small stars."""
    edges, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    spark, seen = edges.sparkSession, None
    while True:
        # large star: the larger neighbours of a node join the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours join the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        before = path
        edges, path = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        remove(spark, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def blocks_of_key(fingerprints: int, radius: int, part: int = PART) -> int:
    """The least number of blocks whose keys deal so many spread fingerprints into shards of a part at most."""
    return next((k for k in SAME if fingerprints <= part << 64 * k // (radius + k)), SAME[-1])


def keyed(fps: DataFrame, radius: int, same: int) -> DataFrame:
    """node, block, value: the keys of each fingerprint fp, each of `same` blocks out of radius + `same`.

    Two fingerprints that differ in at most radius bits differ in so many blocks at most, so they share a key.
    """
    n = radius + same
    cuts = [64 * i // n for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) if n > 1 else F.col("fp")

    def value(chosen: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in chosen:
            out = F.shiftleft(out, cuts[i + 1] - cuts[i]).bitwiseOR(block(i))
        return out

    keys = F.array(*[F.struct(F.lit(i).alias("block"), value(chosen).alias("value")) for i, chosen in enumerate(combinations(range(n), same))])
    return fps.select(F.col("fp").alias("node"), F.explode(keys).alias("s")).select("node", "s.*")


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach) for each row of docs; no link is lost.

    Null texts count as empty, and empty texts share fingerprint 0. Repeated rows stay. A null doc_id is
    never a component's id unless all of its ids are null. An empty table gives an empty table.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    rows = keyed(classes.select("fp"), radius, blocks_of_key(classes.count(), radius))
    linked = materialize(roots(links(rows, radius)), "roots")
    tops = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    named = tops.join(heads, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def first(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set of which any set similar to it holds one among its own first; the common (sorted) come last."""
    least, of = SIMILAR
    n = len(own) - -(-least * len(own) // of) + 1 if len(own) else 0
    if not len(common) or not n:
        return own[:n]
    last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
    return np.concatenate((own[~last], own[last]))[:n]


def similar(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted, without repeats) whose Jaccard similarity is high enough."""
    least, of = SIMILAR
    sizes = np.array([len(x) for x in sets], np.int64)
    _, terms, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[terms] > 1
    terms, owner = terms[shared], owner[shared]
    postings, heads = owner[np.argsort(terms, kind="stable")], np.concatenate(([0], np.cumsum(np.where(counts > 1, counts, 0))))
    rows = np.searchsorted(owner, np.arange(len(sets) + 1))
    label = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    for x in range(1, len(sets)):
        own = terms[rows[x] : rows[x + 1]]
        both = np.zeros(len(sets), np.int64)
        for at in range(0, len(own), 4096):
            a, n = heads[own[at : at + 4096]], counts[own[at : at + 4096]]
            ends = np.cumsum(n)
            both += np.bincount(postings[np.repeat(a - ends + n, n) + np.arange(ends[-1])], minlength=len(sets))
        for y in np.flatnonzero((least + of) * both[:x] >= least * (sizes[:x] + sizes[x])).tolist():
            if label[y] != label[x]:
                label[label == label[x]] = label[y]
                out.append((y, x))
    return out


def _alike(sets: DataFrame, groups: DataFrame, part: int = SETS) -> DataFrame:
    """Links a, b between similar sets (node, own) of one group (node, root); of large groups, in pairs of parts."""
    parts = groups.groupBy("root").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    tasks = groups.join(parts, "root").select("node", "root", own.alias("at"), other)
    tasks = tasks.select("node", "root", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).join(sets, "node")
    dealt = tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, held = None, [], []
        for b in batches:
            out: list[tuple[int, int]] = []
            for node, own, *at in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if at != key:
                    out += [(names[x], names[y]) for x, y in (similar(held) if len(held) > 1 else [])]
                    key, names, held = at, [], []
                names.append(node)
                held.append(np.frombuffer(own, "<u8"))
            yield _edges(out)
        yield _edges([(names[x], names[y]) for x, y in (similar(held) if len(held) > 1 else [])])

    return dealt.select("node", "own", "root", "i", "j").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, common: int = PART) -> DataFrame:
    """copy, kept: doc_ids of near copies and the least doc_id that links of such copies reach.

    Texts are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8; rows that share
    a doc_id are one node. Null texts count as empty and are copies of each other; rows of a null doc_id take no
    part. Shingles that are keys of more than `common` texts come last in the order of keys. Other columns are not
    read; an empty table gives no rows.
    """
    texts = _texts(docs).where("doc_id is not null")
    none = np.zeros(0, "<u8")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *(first(np.unique(shingles(t, NEAR_SHINGLE)), none) for t in b.column(1).to_pylist())]).view(np.int64))], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t, NEAR_SHINGLE)) for t in b.column(1).to_pylist()]
            digest = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            fp = [_signs(x, LANES).to_bytes(8 * LANES, "little") for x in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "digest": pa.array(digest, pa.binary()), "fp": pa.array(fp, pa.binary()), "keys": pa.array([first(x, often).tobytes() for x in sets], pa.binary())})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in held])
            value = np.concatenate([none.view(np.int64), *held])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.zeros(len(at), np.int32)), pa.array(value)], ["node", "block", "value"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, NEAR_SHINGLE)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "own"])

    counts = texts.mapInArrow(keys, "value long").groupBy("value").count()
    often = np.sort(np.array([r.value for r in counts.where(F.col("count") > common).orderBy(F.desc("count"), "value").limit(COMMON).collect()], np.int64).view("<u8"))
    signed = materialize(texts.mapInArrow(run, "doc_id long, digest binary, fp binary, keys binary"), "signatures")
    classes = materialize(signed.groupBy("digest").agg(F.min(F.struct("doc_id", "fp", "keys")).alias("s")).select("digest", F.col("s.doc_id").alias("node"), "s.fp", "s.keys"), "classes")
    rows = classes.select("node", "keys").mapInArrow(spread, "node long, block int, value long")
    groups = materialize(roots(links(rows, CANDIDATE_RADIUS, classes=classes)), "candidates")
    groups = materialize(groups.unionByName(groups.select(F.col("root").alias("node"), "root")).distinct(), "groups")
    sets = texts.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(whole, "node long, own binary").distinct()
    linked = materialize(roots(_alike(sets, groups)), "roots")
    named = classes.join(linked, "node", "left").select("digest", F.coalesce("root", "node").alias("kept"))
    return signed.select("doc_id", "digest").join(named, "digest").where("doc_id <> kept").select(F.col("doc_id").alias("copy"), "kept").distinct()


def fingerprint_text(fp: str = "fp") -> Column:
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without near copies of a smaller doc_id.

    Of rows that are equal in all columns (but maps, which can't be compared) one stays; rows that share a doc_id are
    one document and stay or go together. All rows of a null doc_id stay. Null and empty texts are copies of each
    other. An empty table stays empty.
    """
    copies = near_copies(docs).select(F.col("copy").alias("doc_id")).distinct()
    compared = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # rows without an id aren't dealt by it: they would all meet in one task
    kept = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").select(docs.columns).dropDuplicates(compared)
    return kept.unionByName(docs.where("doc_id is null"))
