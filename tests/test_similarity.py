"""Cosines of smoothed tf-idf vectors against a plain computation, with CJK texts and hot groups."""

import math
import random
import re
from collections import Counter

import pytest

from colloquy.operators import similarity
from pyspark.sql import functions as F


def plain_terms(text):
    low = (text or "").lower()
    signs = re.findall(r"[一-鿿]", low)
    return re.findall(r"\b[a-z0-9_.]+\b", low) + signs + [a + b for a, b in zip(signs, signs[1:], strict=False)]


def plain_near(docs, queries, least):
    tf = {i: Counter(plain_terms(t)) for i, t in docs}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    out = {}
    for q, text in queries:
        asked = {t: n * idf[t] for t, n in Counter(plain_terms(text)).items() if t in idf}
        for i, c in tf.items():
            dot = sum(w * c[t] * idf[t] for t, w in asked.items())
            norms = math.sqrt(sum(w * w for w in asked.values())) * math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
            if norms and dot / norms >= least - 1e-9:
                out[q, i] = dot / norms
    return out


def test_terms(spark):
    texts = ["A.b c_1 图谱分析, x", "é ab éa .b", "分a数", None, "", "1.5 a..", "ab" * 20000]
    rows = similarity.frequencies(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()
    assert {(r.i, r.term): r.tf for r in rows} == {(i, w): n for i, t in enumerate(texts) for w, n in Counter(plain_terms(t)).items()}
    assert similarity.terms("图谱 x.1 分 a.") == ["x.1", "a", "图", "谱", "分", "图谱", "谱分"]


def test_rows_of_one_id_are_one_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a b"), (2, None), (None, "a b"), (3, "c")], "id long, document string")
    got = similarity.near(docs, spark.createDataFrame([(7, "b a")], "query_id long, query string"), 0.9, f"file://{tmp_path}/x")
    assert {(r.query_id, r.id): round(r.similarity, 9) for r in got.collect()} == {(7, 1): 1, (7, 2): 1}


@pytest.mark.parametrize("least", [0.2, 0.6, 0.95])
def test_near_equals_all_pairs(spark, monkeypatch, tmp_path, least):
    rnd = random.Random(5)
    words = ["the", "图", "谱", "分析", "代数", *[f"w{i}" for i in range(40)]]
    text = lambda n: " ".join(rnd.choices(words, weights=[40, 9, 9, 5, 5, *[1] * 40], k=n))
    hot = text(12)
    docs = list(enumerate([hot] * 40 + [hot + " " + text(1) for _ in range(30)] + [text(rnd.randint(1, 25)) for _ in range(120)] + [None, "", "。"]))
    queries = list(enumerate([hot, hot + " unseen", "图谱", "", None, *[text(6) for _ in range(15)], docs[75][1]]))
    monkeypatch.setattr(similarity, "COMMON", 4)  # terms beyond the bound go the other way
    got = similarity.near(spark.createDataFrame(docs, "id long, document string").withColumn("term", F.lit("x")), spark.createDataFrame(queries, "query_id long, query string"), least, f"file://{tmp_path}/x")
    want = plain_near(docs, queries, least)
    assert {(r.query_id, r.id): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 70


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id long, document string")
    some = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert similarity.near(none, some, 0.5, f"file://{tmp_path}/x").count() == 0
    with pytest.raises(ValueError):
        similarity.near(none, some, 0, "")


def test_few_queries_meet_documents_where_they_are_read(spark, monkeypatch, tmp_path):
    rnd = random.Random(8)
    text = lambda n: " ".join(rnd.choices("a b c d e f g h 图 谱".split(), k=n) + [f"only{rnd.random()}"] * rnd.randint(0, 2))
    docs, queries = [(i, text(rnd.randint(0, 12))) for i in range(150)], [(q, text(5)) for q in range(12)]
    want = plain_near(docs, queries, 0.4)
    monkeypatch.setattr(similarity, "HELD", 5)  # counts go on early
    for few, path in ((50_000, "few"), (0, "many")):
        monkeypatch.setattr(similarity, "TERMS", few)
        monkeypatch.setattr(similarity, "COMMON", 3)
        got = similarity.near(spark.createDataFrame(docs, "id long, document string"), spark.createDataFrame(queries, "query_id long, query string"), 0.4, f"file://{tmp_path}/{path}")
        assert {(r.query_id, r.id): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}
        assert (tmp_path / path / "counts").exists() != bool(few)  # a row a document and term is written for many queries only
    assert len(want) > 50
