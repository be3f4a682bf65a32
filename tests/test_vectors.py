"""Quantised search against brute force, Lloyd's rounds against plain ones, and any table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import vectors as vq
from colloquy.plans import queries_search as qs

SCHEMA = "id long, embedding array<double>, code string, list int"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r], "c", 1) for i, r in enumerate(x)], SCHEMA).repartition(4)


def asked(rows):
    return rows.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))


def brute(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(i), d[i]) for i in np.lexsort((np.arange(len(x)), d))[:k]]


def recall(out, x, k):
    by = {}
    for r in out.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.id, r.distance))
    hits = 0
    for q, found in by.items():
        want = brute(x, q, k)
        hits += len({i for i, _ in found} & {i for i, _ in want})
        assert found == sorted(found, key=lambda p: (p[1], p[0])) and all(d == pytest.approx(np.sqrt(((x[i] - x[q]) ** 2).sum()), abs=1e-9) for i, d in found)
    return hits / sum(len(brute(x, q, k)) for q in by)


def test_registered_query_reaches_the_stated_recall(spark):
    d = "/root/testdata/sf0.001"
    rows = [r for r in qs._vectors(spark, d).collect() if r.embedding is not None]
    ids, x = [r.id for r in rows], np.array([r.embedding for r in rows], float)
    assert ids == sorted(ids)
    found = {}
    for r in qs.r21(spark, d).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    assert set(found) == {i for i in ids if i % 20 == 0}
    hits = sum(len(found[q] & {ids[i] for i, _ in brute(x, ids.index(q), 10)}) for q in found)
    assert hits >= 9 * len(found)


@pytest.mark.parametrize("chunk", [65_536, 40])
def test_clusters_and_hot_groups(spark, monkeypatch, chunk):
    monkeypatch.setattr(vq, "LIST_ROWS", 50)
    r = np.random.default_rng(1)
    centres = r.normal(0, 5, (20, 32))
    x = np.concatenate([centres[r.integers(20, size=900)] + r.normal(0, 1, (900, 32)), np.tile(centres[:1], (400, 1))])  # a third are equal
    rows = table(spark, x)
    index = vq.build(rows, 32, chunk=chunk)
    assert index.codes.count() == len(x) and index.codes.groupBy("list", "chunk").count().agg(F.max("count")).first()[0] < (2 * chunk if chunk == 40 else 1_300)
    own = table(spark, x[:900:9]).select((F.col("id") * 9).alias("id"), "embedding")
    assert recall(index.search(asked(own), 5, visits=0.3), x, 5) >= 0.9
    same = index.search(asked(table(spark, x[1_000:1_001], 1_000)), 3).orderBy("rank").collect()
    assert [(s.id, s.distance) for s in same] == [(900, 0.0), (901, 0.0), (902, 0.0)] or len({s.distance for s in same}) == 1


def test_all_lists_and_a_wide_pool_are_exact(spark):
    x = np.random.default_rng(2).normal(0, 1, (300, 16))
    out = vq.build(table(spark, x), 16).search(asked(table(spark, x[:20])), 10, visits=1.0, pool=30)
    assert recall(out, x, 10) == 1 and out.count() == 200


def test_lloyd_equals_plain_rounds(spark):
    x = np.random.default_rng(3).normal(0, 1, (200, 4))
    rows = table(spark, x)
    mine = vq.lloyd(rows, 4, 5, 2, 3)
    first = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(5).collect()]
    for p in (0, 1):
        own, c = x[:, 2 * p : 2 * p + 2], x[first, 2 * p : 2 * p + 2].copy()
        for _ in range(3):
            near = ((own[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(5)])
        assert np.allclose(mine[p], c)


def test_any_table(spark):
    good = [1.0] * 16
    rows = spark.createDataFrame([(1, good), (2, None), (3, [1.0] * 15), (4, [None] + good[1:]), (5, [float("nan")] + good[1:]), (6, [float("inf")] + good[1:]), (None, good), (7, [2.0] * 16), (8, [])], "id long, embedding array<double>")
    out = vq.build(rows, 16).search(asked(rows), 10)
    assert sorted((r.query_id, r.id, r["rank"]) for r in out.collect()) == [(1, 1, 1), (1, 7, 2), (7, 1, 2), (7, 7, 1)]
    none = vq.build(rows.limit(0), 16)
    assert none.search(asked(rows), 3).collect() == []
    with pytest.raises(ValueError):
        vq.build(rows, 10)
