"""Near duplicates against all pairs, sketches against their definition, and any table."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import minhash as mh

SCHEMA = "doc_id long, text string, n long, keys string, component_id long"
WORDS = [a + b for a in ("ka", "mi", "to", "lu", "re") for b in ("ra", "no", "sti", "ble", "wen", "dor", "é", "Xu")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], SCHEMA).repartition(4)


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def plain(rows):
    """component_id by all pairs of rows; rows of one doc_id are one document."""
    sets = [plain_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if None not in (rows[x][0], rows[y][0]) and a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = find(rows[x][0]), find(rows[y][0])
                root[max(p, q)] = min(p, q)
    return sorted((str(i), len(s), str(None if i is None else find(i)), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def edited(r, words, share):
    out = list(words)
    for _ in range(int(share * len(words))):
        out[r.randrange(len(out))] = r.choice(WORDS) + str(r.randrange(99))
    return out


def corpus():
    r, rows = random.Random(6), []
    for _ in range(12):  # families of near copies around the threshold
        base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.choice([7, 20, 60, 300]))]
        rows += [" ".join(edited(r, base, r.choice([0, 0.01, 0.02, 0.03, 0.05, 0.1]))) for _ in range(12)]
    shared = [r.choice(WORDS) for _ in range(200)]
    rows += [" ".join(shared + [f"{r.choice(WORDS)}{r.randrange(1000)}" for _ in range(r.choice([10, 30, 60]))]) for _ in range(40)]  # one passage that many share
    rows += ["one", "one", "one two", "ONE  two", "one two three", "a b c d", "", None, " \n\t", "", "x " * 3_000, "X\x0bx " * 2_000]
    order = list(range(len(rows)))
    r.shuffle(order)
    out = [(i, rows[k]) for i, k in enumerate(order)]
    return [*out, (3, "one two"), (3, out[40][1]), (5, ""), (None, out[0][1]), (None, None), out[7], (-4, out[9][1])]


def told(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_components_equal_all_pairs(spark):
    rows = corpus()
    assert told(mh.components(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize(("part", "elements"), [(3, 10**9), (10, 600), (1, 1)])
def test_parts_of_large_groups_lose_no_link(spark, part, elements):
    rows = [(i, t) for i, (_, t) in enumerate(corpus()) if plain_set(t)]
    docs = table(spark, rows)
    seen, first = {}, {}
    for i, t in rows:
        first.setdefault(frozenset(plain_set(t)), i)
    groups = spark.createDataFrame([(i, len(s), min(first.values())) for s, i in first.items()], "node long, n long, root long")  # all in one group
    for r in mh.verified(docs, groups, part, elements).collect():
        seen[r.node] = r.root
    want = {int(i): int(c) for i, _, c, _ in plain(rows)}
    for i in first.values():
        assert seen.get(i, i) == want[i]


def test_within_and_between_join_what_all_links_join():
    r = np.random.default_rng(5)
    for trial in range(40):
        bases = [r.choice(10_000, 60, replace=False) for _ in range(3)]
        sets = [np.unique(np.where(r.random(60) < r.choice([0, 0.03, 0.08, 0.2]), r.integers(0, 10_000, 60), bases[r.integers(3)])).astype(np.uint64) for _ in range(r.integers(1, 40))]
        like = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))

        def classes(n, pairs):
            label = list(range(n))
            for x, y in pairs:
                label = [label[x] if c == label[y] else c for c in label]
            return [label.index(c) for c in label]

        every = [(x, y) for x in range(len(sets)) for y in range(x) if like(sets[x], sets[y])]
        mine = mh.within(sets)
        assert all(like(sets[x], sets[y]) for x, y in mine) and classes(len(sets), mine) == classes(len(sets), every)
        cut = len(sets) // 2
        a, b = sets[:cut], sets[cut:]
        found = mh.between(a, np.arange(cut), b, np.arange(cut, len(sets)))
        assert all(like(b[x], a[y]) for x, y in found)
        assert classes(len(sets), [(cut + x, y) for x, y in found]) == classes(len(sets), [(cut + x, y) for x in range(len(b)) for y in range(cut) if like(b[x], a[y])])


def test_every_coordinate_fills_with_its_least_hash():
    for n in (0, 1, 2, 6, 100, 5_000):
        own = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        got, want = mh.sketch(own), [2**64 - 1] * mh.T
        for i in range(2 * mh.T if n else 0):
            for h in mh._mixed(own ^ mh._ROUND[i]).tolist():
                place = (h >> 32) * mh.T >> 32 if i < mh.T else i - mh.T
                value = i << 54 | int((mh._mixed(np.array([h], np.uint64)) >> np.uint64(10))[0])
                want[place] = min(want[place], value)
            if n == 5_000 and i >= 1:
                break
        assert got.tolist() == want
        assert n == 0 or (got != mh._FREE).all()


@pytest.mark.parametrize(("n", "share"), [(8, 0.9), (200, 0.85), (3_000, 0.85), (500, 0.3)])
def test_agreements_estimate_similarity(n, share):
    r = np.random.default_rng(n)
    rates, shared = [], 0
    for _ in range(60):
        union = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        r.shuffle(union)
        both, one = union[: round(share * n)], union[round(share * n) :]
        x, y = (np.sort(np.concatenate((both, part))) for part in (one[::2], one[1::2]))
        a, b = mh.sketch(x), mh.sketch(y)
        rates.append((a == b).mean())
        shared += bool(set(mh.keys(a).tolist()) & set(mh.keys(b).tolist()))
    truth = round(share * n) / n
    assert abs(np.mean(rates) - truth) < 0.02 and np.std(rates) < 1.6 * (truth * (1 - truth) / mh.T) ** 0.5
    assert shared == 60 or share < 0.8


def test_a_large_group_of_near_copies(spark):
    r = random.Random(1)
    base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(150)]
    rows = [(i, " ".join(edited(r, base, 0.015))) for i in range(600)]
    got = mh.components(table(spark, rows))
    assert told(got) == plain(rows)


def test_any_table(spark):
    assert mh.components(table(spark, [])).collect() == []
    out = mh.components(table(spark, [(None, None), (1, None), (2, ""), (7, "a")]))
    assert told(out) == [("1", 0, "1", True), ("2", 0, "2", True), ("7", 1, "7", True), ("None", 0, "None", True)]
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "bigint", "bigint", "boolean"]
    assert out.where(F.col("kept")).count() == 4
