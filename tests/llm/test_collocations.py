"""Collocations against plain counting, the automaton against enumeration, and any table."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, f long, phrase string, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", "s") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def split(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain(rows, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in split(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= 30}
    out = {}
    for (lang, g), a in f.items():
        if len(g) < 2:
            continue
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        over = max([v for (x, h), v in f.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))], default=0)
        if 100 * over < 80 * a:
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top])}


def text(r, n):
    words = ["ra", "No", "sti", "blé", "wen", "dor", "的", "x"]
    return "".join(r.choice(words) + r.choice([" "] * 9 + ["\t ", ", ", "\n", "! ", "\x0c"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(text(r, r.randrange(250)), r.choice(["en", "de", None])) for _ in range(120)] + [(text(r, 3_000), "en")]
    return out + [(f"once upon a time{' and so' * (i % 3)}", "en") for i in range(50)] + [("same row here", "fr")] * 45 + [(None, "en"), ("", None), (" .\n", "en"), ("word", ""), ("a\xa0b c", "fr")]


@pytest.mark.parametrize(("size", "ranges"), [(1 << 21, 512), (300, 4)])
def test_collocations_equal_plain_counting(spark, rows, size, ranges):
    got = {tuple(r) for r in co.collocations(table(spark, rows), 50, size, ranges).collect()}
    assert got == plain(rows, 50) and {lang for lang, *_ in got} == {"en", "de", "fr", "und"}


def test_words_and_pieces_are_those_of_the_pattern():
    r = random.Random(8)
    for _ in range(200):
        t = "".join(r.choice("aB é.\t,;:!?\n\x0b\x0c\r\x1c\x85\xa0   ") for _ in range(60))
        words, pieces = [w for part in co.tokens(t, 7) for w in part], [[]]
        for w in words:
            pieces.append([]) if w == b"." else pieces[-1].append(w.decode())
        assert [p for p in pieces if p] == split(t)


def test_states_links_and_counts_of_an_automaton():
    r = np.random.default_rng(3)
    ids = r.integers(-1, 5, 3_000).astype(np.int32)
    a = co.Automaton(ids, [b"a", b"b", b"c", b"d", b"e"])
    for _ in range(3):
        a.grow()
    for n in range(1, 5):
        seen = Counter(tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1) if (ids[i : i + n] >= 0).all())
        mine = {tuple(b"abcde".index(w.encode()) for w in a.text(n, s).split(" ")): (int(a.count[n - 1][s]), s) for s in range(len(a.count[n - 1]))}
        assert {k: v for k, (v, _) in mine.items()} == seen
        for g, (_, s) in mine.items():
            for x in range(n):
                for y in range(n - x):
                    size, state = a.inner(n, s, x, y)
                    assert a.text(size, state) == " ".join("abcde"[i] for i in g[x : n - y])
    digests, counts, _ = a.listed((1, 2, 3, 4))
    assert len(np.unique(digests)) == len(digests) and (np.diff(digests["a"].astype(object)) >= 0).all() and counts.sum() == sum(c.sum() for c in a.count)


def test_digests_do_not_depend_on_the_shard():
    one, two = co.Automaton(np.array([0, 1, 2, -1], np.int32), [b"a", b"b", b"c"]), co.Automaton(np.array([0, 1, -1, 2, 1, 0], np.int32), [b"c", b"b", b"a"])
    for a in (one, two):
        a.grow()
        a.grow()
    told = lambda a: {(n, a.text(n, s)): tuple(int(x[s]) for x in a.lanes[n - 1]) for n in (1, 2, 3) for s in range(len(a.count[n - 1]))}
    x, y = told(one), told(two)
    assert all(x[k] == y[k] for k in x.keys() & y.keys()) and len({*x.values(), *y.values()}) == len(x | y)


def test_digests_that_share_their_first_half(spark):
    block = lambda shard, pairs: ("en", 0, shard, 0, np.array([p[:2] for p in pairs], co._DIGEST).tobytes(), np.array([p[2] for p in pairs], "<u4").tobytes())
    blocks = spark.createDataFrame([block(1, [(5, 1, 20), (5, 2, 29), (9, 1, 1)]), block(2, [(5, 1, 10), (5, 3, 30)])], co.BLOCKS)
    got = {r.shard: (np.frombuffer(r.found, "<u4").tolist(), np.frombuffer(r.own, "<u4").tolist(), np.frombuffer(r.totals, "<i8").tolist()) for r in co.frequent(blocks).collect()}
    assert got == {1: ([0], [0], [30]), 2: ([0, 1], [1], [30])}


def test_any_table(spark):
    for rows in ([], [(None, None)], [("", "en"), ("a b", "en")]):
        out = co.collocations(table(spark, rows))
        assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
