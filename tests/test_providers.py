"""Providers are called once for each distinct input, and what they return is checked."""

import pytest

from colloquy.operators import providers

CONTRACT = providers.Contract("hash", "md5", 8, "1")


def test_embeddings_are_cached_and_checked(spark):
    rows = spark.createDataFrame([("a b",), ("a b",), ("c",), (None,)], "text string")
    first = providers.embed_texts(rows, "text", providers.hashed_embedder(8), CONTRACT)
    assert {r.cache_key for r in first.collect()} == {CONTRACT.key("a b"), CONTRACT.key("c")}

    def never(texts):
        raise AssertionError("asked again")

    cached = spark.createDataFrame(first.collect(), first.schema)
    assert providers.embed_texts(rows, "text", never, CONTRACT, cached).count() == 2
    with pytest.raises(Exception, match="wrong number"):
        providers.embed_texts(rows, "text", lambda t: [[0.0]] * len(t), CONTRACT).collect()
    with pytest.raises(ValueError, match="dimension"):
        CONTRACT.check(providers.Contract("hash", "md5", 9, "1"))


def test_reranker_must_be_a_permutation(spark):
    rows = spark.createDataFrame([(1, "x", "one two", "two"), (1, "y", "one two", "one two"), (1, "z", "one two", "two")], "query_id long, id string, query string, text string")
    got = providers.rerank(rows, providers.overlap_reranker).orderBy("reranker_rank").collect()
    assert [r.id for r in got] == ["y", "x", "z"]
    with pytest.raises(Exception, match="each candidate once"):
        providers.rerank(rows, lambda q, t: [(0, 1.0)]).collect()
