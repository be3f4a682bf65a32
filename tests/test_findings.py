"""Cases of the findings: rare texts and larger groups, where queries once differed from their SQL or grew too fast."""

import os
import random

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from colloquy import queries
from colloquy.operators import assembly, lexical, metrics, retrieval
from colloquy.plans import routing
from colloquy.sources import postings

from .oracle import same

SF = "/root/testdata/sf0.001"


def altered(tmp_path, **tables):
    """The small tables, some of them replaced by what DuckDB makes of them."""
    for name in os.listdir(SF):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{SF}/{name}", tmp_path / name)
    with duckdb.connect() as con:
        for name, sql in tables.items():
            con.execute(f"COPY ({sql.format(f'{SF}/{name}.parquet')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def checked(spark, d, name):
    same(spark, d, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["b10_window_selection", "b11_micro_evidence"])
def test_words_inside_a_students_question_ask_for_nothing(spark, tmp_path, name):
    d = altered(tmp_path, conversations="SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 0 THEN 'teacherque ' WHEN 1 THEN 'an intervention ' WHEN 2 THEN 'Hié ' ELSE '' END || text AS text FROM '{}'")
    checked(spark, d, name)


def _graded_case(spark):
    windows = spark.createDataFrame([(f"w{s}_{i}", s, "AB"[s % 2], [2 * i + 1, 2 * i + 2]) for s in range(12) for i in range(3)], "chunk_id string, session_id long, subject_path string, source_turn_ids array<int>")
    required = spark.createDataFrame([(q, s, t) for q in range(12) for s in (q, (q + 1) % 12) for t in (1, 2) if q != 5], "query_id long, session_id long, turn_id int")
    cases = spark.createDataFrame([(q, ["A", "B", ""][q % 3]) for q in range(12)], "query_id long, subject_path string")
    return windows, required, cases


def _graded_by_hand(windows, required, cases):
    want = {}
    for r in required.collect():
        want.setdefault(r.query_id, set()).add((r.session_id, r.turn_id))
    out = {}
    for c in cases.collect():
        for w in windows.collect():
            need = want.get(c.query_id, set())
            overlap = len(need & {(w.session_id, t) for t in w.source_turn_ids})
            if need and (w.session_id in {s for s, _ in need} or c.subject_path and w.subject_path == c.subject_path):
                out[c.query_id, w.chunk_id] = (overlap, 3 if overlap == len(need) else 2 if overlap else 1)
    return out


def test_graded_pairs_are_whole_and_never_shuffled(spark):
    case = _graded_case(spark)
    rows = metrics.graded_qrels(*case)
    got = rows.collect()
    assert {(r.query_id, r.chunk_id): (r.overlap, r.relevance) for r in got} == _graded_by_hand(*case) and len(got) == len(_graded_by_hand(*case))
    assert rows._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # pairs go on from the join that makes them


def test_graded_pairs_come_from_blocks_of_cases(spark, monkeypatch):
    """Windows aren't copied for parts of the cases, and blocks of a few cases lose and repeat no pair."""
    monkeypatch.setattr(metrics, "BLOCK", 2, raising=False)
    case = _graded_case(spark)
    rows = metrics.graded_qrels(*case)
    got = rows.collect()
    assert {(r.query_id, r.chunk_id): (r.overlap, r.relevance) for r in got} == _graded_by_hand(*case) and len(got) == len(_graded_by_hand(*case))
    below = lambda p: [p] + [x for i in range(p.children().size()) for x in below(p.children().apply(i))]
    names = lambda p: {p.output().apply(i).name() for i in range(p.output().size())}
    windows, blocks = (p for p in below(rows._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "RepartitionByExpression")
    assert "chunk_id" in names(windows) and all(p.nodeName() != "Generate" for p in below(windows))
    assert "ids" in names(blocks) and "query_id" not in names(blocks)


def test_first_graded_rows_need_no_pairs(spark):
    case = _graded_case(spark)
    ranked, own = metrics.first_graded(*case, [F.desc(F.length("chunk_id")), F.asc("chunk_id")], 4)
    whole = _graded_by_hand(*case)
    first = {q: sorted((c for k, c in whole if k == q), key=lambda c: (-len(c), c))[:4] for q, _ in whole}
    assert {(r.query_id, r.id, r["rank"]) for r in ranked.collect()} == {(q, c, i) for q, cs in first.items() for i, c in enumerate(cs, 1)}
    held = {(r.query_id, r.chunk_id): (r.overlap, r.relevance) for r in own.collect()}
    assert held.items() <= whole.items() and {k for k, v in whole.items() if v[1] >= 2} <= set(held)
    assert len(held) < len(whole)


def test_mmr_best_prunes_and_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(assembly, "ROUNDS", (2, 8))
    monkeypatch.setattr(assembly, "PACKS", 3)
    monkeypatch.setattr(assembly, "PACK", 4)
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 12)))
    cands = [(q, f"c{i:03d}", 0.5 + rng.choice((0, 0.01)), text()) for q in range(3) for i in range(60)]
    chosen = [(q, text()) for q in range(2) for _ in range(50)]
    met = []
    likest = assembly._likest
    monkeypatch.setattr(assembly, "_likest", lambda c, h: met.append(c.count() * h.count()) or likest(c, h))
    words = lambda t: set(t.split())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {}
    for q, i, score, t in cands:
        v = round(0.7 * score - 0.3 * max((like(words(t), words(x)) for k, x in chosen if k == q), default=0.0), 9)
        want[q] = min(want.get(q, (9, "")), (-v, i))
    for few in (10_000, 0):
        monkeypatch.setattr(assembly, "FEW", few)
        got = assembly.mmr_best(spark.createDataFrame(cands, "query_id long, id string, score double, text string"), spark.createDataFrame(chosen, "query_id long, text string"))
        assert {r.query_id: (-r.mmr, r.id) for r in got.collect()} == want
    assert len(met) > 2 and met[-1] < len(cands) * len(chosen) / 2  # all pairs are made of the few candidates that are left


@pytest.mark.parametrize("k", [None, 3])
def test_scores_without_an_index_equal_the_join(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(lexical, "ROWS", 5)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab bc cd de ef fg 12 3.5 é 中").strip() + rng.choice("abcd ") for _ in range(n))
    rows = [(i, text(rng.randint(0, 30))) for i in range(60)] + [(60, None), (61, ""), (62, "zz zz"), (63, "zz zz")]
    docs = spark.createDataFrame(rows, "id long, document string")
    asked = spark.createDataFrame([(q, text(6)) for q in range(7)] + [(7, "zz"), (8, "nowhere"), (9, None)], "query_id long, query string")
    whole = {(r.query_id, r.id): round(r.bm25, 9) for r in retrieval.bm25(docs, asked).collect()}
    got = {(r.query_id, r.id): round(r.bm25, 9) for r in lexical.scores(docs, asked, str(tmp_path / "f"), k).collect()}
    assert got == whole if k is None else got.items() <= whole.items()
    first = lambda rows: {q: sorted((-round(v, 6), i) for (p, i), v in rows.items() if p == q)[:3] for q in range(10)}
    assert first(got) == first(whole)


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    d = altered(tmp_path, documents="SELECT * REPLACE (doc_id // 2 AS doc_id) FROM '{}'")
    for name in ("a11_document_frequency", "r1_bm25", "k2_bm25_top"):
        checked(spark, d, name)


def test_scores_write_no_index(spark, monkeypatch):
    monkeypatch.setattr(postings.LexicalIndex, "write", lambda *a, **k: pytest.fail("all postings of the table were written"))
    for name in ("a11_document_frequency", "r1_bm25", "k2_bm25_top", "r9_rrf_fusion", "b1_boosted_scores", "r6_hybrid_ranking", "k1_hybrid_top5"):
        queries.QUERIES[name](spark, SF)


def test_routes_hold_the_finds_of_few_texts():
    texts = [pd.Series([f"why rounding {i} 12345" for i in range(1000)]), pd.Series([], dtype=object), pd.Series([None, "x"])]
    own = routing.Vocabulary({}, {}, {}, unsupported=("rounding",), id_words=("why",))
    got = list(routing._read(iter(texts), routing.Finder(own.groups()), own))
    assert max(map(len, got)) <= routing.ROWS and sum(map(len, got)) == 1002
    assert [r for f in got for r in f.question_ids][:1001] == [["12345"]] * 1000 + [[]]


def _cards_and_questions(spark):
    rng = random.Random(11)
    words = ["round", "angle", "the", "of", "half", "way", "around", "ground", "x"]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.8 else str(rng.randint(5, 130_000)) for _ in range(n))
    cards = [(f"c{i:03d}", rng.choice(["MISCONCEPTION", "TUTOR_STRATEGY"]), i % 40, i % 9 + 12_340, text(rng.randint(0, 6)), text(rng.randint(0, 9))) for i in range(150)]
    cards += [(None, "MISCONCEPTION", 1, 1, "round", "round"), ("n1", "MISCONCEPTION", 2, None, None, "the round"), ("n2", "TUTOR_STRATEGY", 3, 12_341, "half way", None)]
    asked = [(q, rng.choice(["", "tutor ", "misconception ", "回顾 ", "question 12345 "]) + text(5)) for q in range(20)] + [(20, None), (21, ""), (None, "round"), *[(22 + i, cards[i][4]) for i in range(5)]]
    return spark.createDataFrame(cards, "chunk_id string, card_type string, session_id long, question_id long, question_text string, searchable string"), spark.createDataFrame(asked, "query_id long, query string")


def test_domain_words_count_within_other_words(spark, monkeypatch):
    cards = spark.createDataFrame([("a", "MISCONCEPTION", 1, "", "all around"), ("b", "MISCONCEPTION", 1, "", "nothing")], "chunk_id string, card_type string, session_id long, question_text string, searchable string")
    asked = spark.createDataFrame([(1, "rounding")], "query_id long, query string")
    for most in (2_000, 0):
        monkeypatch.setattr(retrieval.met, "QUERIES", most)
        assert [(r.chunk_id, r.score) for r in retrieval.card_scores(cards, asked).collect()] == [("a", 20)]


def test_cards_meet_queries_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(retrieval.met, "ROWS", 7)
    cards, asked = _cards_and_questions(spark)
    met = retrieval.card_scores(cards, asked)
    assert "Aggregate" not in met._jdf.queryExecution().optimizedPlan().toString()  # no pairs are put together
    columns = sorted(met.columns)
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    got = rows(met)
    monkeypatch.setattr(retrieval.met, "QUERIES", 0)
    assert got == rows(retrieval.card_scores(cards, asked)) and len(got) > 300


def test_a_limit_leaves_out_only_what_ranks_behind_it(spark, monkeypatch):
    monkeypatch.setattr(retrieval.met, "HELD", 50)
    cards, asked = _cards_and_questions(spark)
    cards = cards.repartition(3)
    dense = cards.where("chunk_id < 'c060'").join(asked.where("query_id < 4").select("query_id")).select("query_id", "chunk_id", "card_type", F.lit(1).alias("embedding_rank"), (1.0 / F.length("chunk_id")).alias("embedding_score"))
    for pool in (lambda k: retrieval.card_scores(cards, asked, k), lambda k: retrieval.card_pool(cards, asked, dense, k)):
        few, every = pool(3), pool(None)
        assert few.count() < every.count()
        columns = sorted(every.columns)
        rows = lambda df: sorted(map(str, retrieval.rank_cards(df, 3).select("lane_rank", "position", *columns).collect()))
        assert rows(few) == rows(every)
