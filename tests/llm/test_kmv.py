"""Window algebra against sets, sketches against their definition, and any table."""

import datetime
import random

import numpy as np
import pytest

from colloquy.llm import kmv

SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string, day string, sketch int"


def clicks(spark, rows):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, None if d is None else at + datetime.timedelta(days=d, hours=i % 24), c, k, "x", 1) for i, (d, c, k) in enumerate(rows)], SCHEMA).repartition(5)


def plain(rows):
    """The exact counts by sets."""
    start = (datetime.date(2024, 1, 1) - datetime.date(1970, 1, 1)).days
    seen = {(d, c, k) for d, c, k in rows if d is not None and c is not None and k is not None}
    kinds, out = {k for _, _, k in seen}, {}
    for day in {d for d, _, _ in seen}:
        for a in kinds:
            for b in kinds:
                x = {c for d, c, k in seen if k == a and day - 28 < d <= day}
                y = {c for d, c, k in seen if k == b and day - 58 < d <= day - 30}
                out[start + day, a, b] = len(x | y), len(x & y), len(x - y)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(r.choice([0, 3, 27, 28, 29, 30, 31, 57, 58, 59, 90, 91, 150]), r.randrange(40), r.choice("abc")) for _ in range(400)]
    out += [(d, 7, "a") for d in range(0, 160, 7)] * 20  # one client has most rows
    return out + [(None, 1, "a"), (5, None, "a"), (5, 1, None), (200, 1, "late")]


def test_exact_counts_equal_sets(spark, rows):
    got = {(r.day, r.kind_a, r.kind_b): (r.n_union, r.n_both, r.n_only_a) for r in kmv.window_algebra(clicks(spark, rows)).collect()}
    assert got == plain(rows)


def test_small_sets_are_counted_without_error(spark, rows):
    for r in kmv.window_algebra(clicks(spark, rows)).collect():
        assert (r.est_union, r.est_both, r.est_only_a) == (r.n_union, r.n_both, r.n_only_a)
        assert r.err_union == r.err_both == r.err_only_a == 0


def test_sketches_of_windows_are_those_of_their_sets(spark, monkeypatch, rows):
    monkeypatch.setattr(kmv, "SALTS", 3)
    used = kmv.used(clicks(spark, rows))
    hashes = {(r.kind, r.day, r.h) for r in used.collect()}
    out = {(r.kind, r.day): np.frombuffer(r.sketch, np.uint64).tolist() for r in kmv.windows(kmv.daily(used)).collect()}
    want = {}
    for kind in {k for k, _, _ in hashes}:
        for end in range(min(d for _, d, _ in hashes), max(d for _, d, _ in hashes) + 28):
            if own := {h % 2**64 for k, d, h in hashes if k == kind and end - 28 < d <= end}:
                want[kind, end] = sorted(own)[: kmv.K]
    assert {k: v for k, v in out.items() if v} == want


def test_merged_sketches_do_not_depend_on_order():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 2**63, 3_000).astype(np.uint64) for _ in range(5)]
    want = np.unique(np.concatenate(parts))[:100]
    assert (kmv.merge([kmv.merge(parts[:2], 100), kmv.merge(parts[2:], 100)], 100) == want).all()
    assert len(kmv.merge([])) == 0


@pytest.mark.parametrize(("a", "b", "both"), [(30_000, 20_000, 10_000), (5_000, 5_000, 0), (3_000, 3_000, 3_000), (2_500, 0, 0), (40_000, 40_000, 30)])
def test_errors_hold_the_truth_in_nine_of_ten(a, b, both):
    r, held = np.random.default_rng(a + both), np.zeros(3)
    for _ in range(60):
        h = np.unique(r.integers(0, 2**64, a + b - both, dtype=np.uint64))
        r.shuffle(h)
        x, y = np.unique(h[:a])[: kmv.K], np.unique(h[a - both :])[: kmv.K]
        told = kmv.estimate(x, y)
        truth = np.array([a + b - both, both, a - both])
        held += np.abs(truth - told[:3]) <= told[3:]
        assert all(0 <= e <= 8 * told[0] / 2048**0.5 + 3 for e in told[3:]) and all(v >= 0 for v in told[:3])
    assert (held >= 56).all()


def test_any_table(spark):
    assert kmv.window_algebra(clicks(spark, [])).collect() == []
    none = kmv.window_algebra(clicks(spark, [(None, 1, "a"), (1, None, "a"), (1, 1, None)]))
    assert none.collect() == [] and len(none.columns) == 12
    one = kmv.window_algebra(clicks(spark, [(3, 9, "a")] * 3)).collect()
    assert [(r.n_union, r.n_both, r.n_only_a, r.est_union, r.err_union) for r in one] == [(1, 0, 1, 1.0, 0.0)]


def test_too_many_kinds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(kmv, "MAX_KINDS", 2)
    with pytest.raises(ValueError):
        kmv.window_algebra(clicks(spark, [(1, 1, k) for k in "abc"]))
