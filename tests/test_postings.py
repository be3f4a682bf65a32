"""The persisted index against scores made anew, what it reads, and its versions."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import retrieval as rt
from colloquy.sources import postings, store
from colloquy.sources.postings import LexicalIndex

R = random.Random(3)
WORDS = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmno"]
WEIGHTS = [1 / (i + 1) for i in range(300)]


def text(n):
    return " ".join(R.choices(WORDS, WEIGHTS, k=n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(R.randrange(1, 60))) for i in range(-40, 260)]
    rows += [(900 + i, f"{text(10)} rare{"abc"[i % 3]} scarce") for i in range(9)] + [(7_000, None), (7_001, ""), (7_002, "wab " * 400), (None, "wab wac scarce"), (5_000_000_000, "scarce wab")]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, document string, tf int, term string").repartition(4)


@pytest.fixture(scope="module")
def queries(spark):
    asked = ["waa wab wac rareb scarce", "waa wab", "waf waf waj wsa", "nothing here", "", None, "scarce", text(30)]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")


@pytest.fixture
def index(spark):
    return LexicalIndex(spark, store.scratch(spark))


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.bm25, 6)) for r in df.collect())


@pytest.mark.parametrize(("span", "segments", "buckets"), [(256, 4096, 32), (8, 4, 3), (1, 1, 1)])
def test_scores_and_first_documents_equal_those_made_anew(index, docs, queries, span, segments, buckets):
    known = docs.where("id is not null")
    if span == 1:
        known = known.where("id between -12 and 12 or id > 6999")
    index.write("a", known, span, segments, buckets)
    snap = index.open("a")
    for k, k1, b in ((5, 1.5, 0.75), (1, 2.0, 1.0)):
        want = rt.bm25(known, queries, k1, b)
        mine = {(r.query_id, r.id): r.bm25 for r in snap.scores(queries, k1, b).collect()}
        assert mine == pytest.approx({(r.query_id, r.id): r.bm25 for r in want.collect()})
        first = rt.top(want.withColumn("bm25", F.round("bm25", 6)), [F.desc("bm25"), F.asc("id")], k)
        assert rows(snap.top(queries, k, k1, b)) == rows(first)
    df = {r.term: r.df for r in snap.frequencies().collect()}
    assert df == {r.term: r.n for r in rt.postings(known).groupBy("term").agg(F.count("*").alias("n")).collect()}


def test_no_score_is_above_its_blocks_largest(index, docs, queries):
    index.write("a", docs, 16)
    snap = index.open("a")
    own, asked = snap._asked(queries)
    most = {(r.term, r.segment): r.most for r in snap._maxima(own, asked, 1.2, 0.6).collect()}
    alone = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), " "))).alias("query")).where("query <> ''")
    terms = alone.select(F.col("query").alias("query_id"), "query").distinct()
    best = {}
    for r in snap.scores(terms, 1.2, 0.6).collect():
        at = r.query_id, r.id // 16
        best[at] = max(best.get(at, 0), r.bm25)
    assert best == pytest.approx(most)  # the frontier holds the block's best, not only a bound


def test_common_words_are_read_only_where_they_matter(spark, index):
    body = [(i, text(40)) for i in range(4_000)] + [(4_000 + 300 * i, "needle haystack") for i in range(5)]
    index.write("a", spark.createDataFrame(body, "id long, document string"), 64)
    snap = index.open("a")
    asked = spark.createDataFrame([(1, "needle haystack waa wab wac"), (2, "waa")], "query_id long, query string")
    read = {r.query_id: r for r in snap.read(asked, 3).collect()}
    assert read[1].read * 5 < read[1].blocks and read[2].read == read[2].blocks
    assert [r.id for r in snap.top(asked.where("query_id = 1"), 3).orderBy("rank").collect()] == [4_000, 4_300, 4_600]


def test_a_version_writes_only_what_changed(spark, index, docs, queries):
    known = docs.where("id is not null")
    first = index.write("a", known, 8, 4)
    assert len(first) > 10 and index.write("same", known.repartition(7), 8, 4) == []
    other = known.where("id <> 9").withColumn("document", F.when(F.col("id") == 100, "scarce scarce").otherwise(F.col("document")))
    assert index.write("b", other, 8, 4) == [9 // 32, 100 // 32]
    assert index.write("c", known.where("id < 900"), 8, 4) == [9 // 32, 100 // 32]
    assert index.write("d", known, 16, 4) != []  # another layout shares nothing
    for name, of in (("a", known), ("b", other), ("c", known.where("id < 900"))):
        snap = index.open(name)
        assert snap.documents == of.count()
        assert rows(snap.top(queries, 5)) == rows(rt.top(rt.bm25(of, queries).withColumn("bm25", F.round("bm25", 6)), [F.desc("bm25"), F.asc("id")], 5)), name


def test_a_writer_that_dies_changes_nothing(index, docs, queries, monkeypatch):
    index.write("a", docs, 8, 4)
    before = rows(index.open("a").top(queries, 3))
    monkeypatch.setattr(LexicalIndex, "_blocks", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        index.write("a", docs.where("id > 50"), 8, 4)
    assert rows(index.open("a").top(queries, 3)) == before
    with pytest.raises(ValueError):
        index.open("b")


def test_empty_tables(spark, index, queries):
    none = spark.createDataFrame([], "id long, document string")
    assert index.write("a", none) == [] and index.open("a").top(queries, 3).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "id long, document string")
    index.write("b", blank)
    assert index.open("b").documents == 2 and index.open("b").scores(queries).collect() == []
    index.write("c", spark.createDataFrame([(1, "scarce")], "id long, document string"))
    assert index.open("c").top(queries.limit(0), 3).collect() == []


def test_postings_stay_where_they_are_read_and_are_never_joined(spark, index, docs, queries, monkeypatch):
    known = docs.where("id is not null")
    in_order = known.repartitionByRange(4, "id")
    for rows_of, moved in ((in_order.localCheckpoint(), False), (known.localCheckpoint(), True)):
        plan = index._blocks(rows_of.withColumn("part", F.lit(0)), 8, 4, 3)._jdf.queryExecution().optimizedPlan().toString()
        assert ("Repartition" in plan) == moved and "Aggregate" not in plan
    index.write("a", in_order, 8, 4, 3)
    snap = index.open("a")
    few = rows(snap.top(queries, 3))
    with monkeypatch.context() as m:
        m.setattr(type(snap), "_parts", lambda *a: pytest.fail("postings were joined with a few queries"))
        m.setattr(postings, "PAIRS", 5)
        assert rows(snap.top(queries, 3)) == few
    monkeypatch.setattr(postings, "QUERIES", 0)
    assert rows(snap.top(queries, 3)) == few
