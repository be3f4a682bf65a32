"""Micro evidence by each way of asking, assembly against brute force, sinks that fail, models that answer wrongly, gates."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import assembly, evidence, metrics, micro, providers, retrieval as rt, windows
from colloquy.plans import planner, router
from colloquy.sources import store, tables

SAID = ["hello there", "how are you", "I think it is forty", "look at 36 first", "is 36 even then", "what does half mean", "half of it I guess", "then take 18 away", "18 is what I said", "so the answer is 54", "fine, done now", "bye"]


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(1, i + 1, "student" if i % 2 == 0 else "tutor", i % 2 == 1, x, i == 0) for i, x in enumerate(SAID)]
    turns = spark.createDataFrame(rows, "session_id long, turn_id int, speaker string, is_tutor boolean, text string, is_noise boolean")
    cards = [("m", "MISCONCEPTION", 1, [1, 3, 5, 7, 9, 11], "what is 36 and 18", None, ["18 is what I said"]), ("k", "TUTOR_STRATEGY", 2, [2, 4, 6, 8, 10], "what is 36 and 18", "take 18 away?", [])]
    cards = spark.createDataFrame([(1, p, c, kind, 1, ids, q, key, quotes, "name", "goal") for c, kind, p, ids, q, key, quotes in cards], "query_id long, position int, chunk_id string, card_type string, session_id long, source_turn_ids array<int>, question_text string, key_aha_question string, quotes array<string>, misconception_name string, pedagogical_goal string")
    return turns, cards


@pytest.mark.parametrize("query,parents,anchor,first", [
    ("what did the student think", ["m"], 3, 1),  # the first pointer that says something
    ("推理过程", ["m"], 3, 1),  # the last pointer before the question's first number
    ("课堂原话", ["m"], 9, 4),  # the quote with a number
    ("tutor intervention", ["k", "m"], 8, 4),  # the strategy's number
    ("student and 54", ["m"], 3, 4),  # a number of the query, though the anchor is elsewhere
    ("回顾 54", ["m"], 3, 1),  # a review doesn't look for numbers
])
def test_the_window_that_answers(spark, talk, query, parents, anchor, first):
    turns, cards = talk
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    chosen = micro.parents(cards, asked)
    assert [r.chunk_id for r in chosen.orderBy("parent_rank").collect()] == parents
    marks = micro.anchors(chosen, asked, turns)
    assert marks.first().anchor == anchor
    got = micro.choose_window(micro.window_pool(chosen, asked, turns), marks, asked).collect()
    assert [r.first_turn for r in got] == [first]


def test_evidence_cites_own_turns_within_the_window(spark, talk):
    turns, cards = talk
    asked = spark.createDataFrame([(1, "what did the student think"), (2, "nothing here")], "query_id long, query string")
    events = spark.createDataFrame([("m", 1, [1, 3, 5, 7, 9, 11])], "source_card_id string, source_session_id long, source_turn_ids array<int>")
    r, = micro.evidence(cards, asked, turns, events).collect()
    assert (r.status, r.window_id, [c.turn_id for c in r.citations]) == ("SUCCESS", "session_1_win_1_7", [1, 3, 5, 7])
    assert r.prompt.startswith(micro.SECTIONS[0] + "\nm: name") and "[Turn 7] [student] half of it I guess" in r.prompt
    r, = micro.evidence(cards, asked, turns, events.limit(0)).collect()
    assert (r.status, r.prompt) == ("NO_EVIDENCE", None)


def test_card_order_and_dense_hits(spark):
    cards = spark.createDataFrame([("a", "MISCONCEPTION", 5, 11111, "what is 36", "round the fraction"), ("b", "MISCONCEPTION", 4, 22222, "a sum", "round"), ("c", "TUTOR_STRATEGY", 3, 33333, "a sum", "other words"), ("d", "MISCONCEPTION", 2, 44444, None, "zebra")], "chunk_id string, card_type string, session_id long, question_id long, question_text string, searchable string")
    ask = lambda q: spark.createDataFrame([(1, q)], "query_id long, query string")
    order = lambda q: [r.chunk_id for r in rt.rank_cards(rt.card_scores(cards, ask(q))).orderBy("position").collect()]
    assert order("36 round") == ["a", "b"]
    assert order("round for the student") == ["a", "b", "d"]  # two shared words before one; the lane brings in the rest
    assert order("question 33333 round") == ["c"]
    dense = spark.createDataFrame([(1, "d", "MISCONCEPTION", 1, 0.9), (1, "b", "MISCONCEPTION", 2, 0.8)], "query_id long, chunk_id string, card_type string, embedding_rank int, embedding_score double")
    pool = {r.chunk_id: r.channels for r in rt.card_pool(cards, ask("round"), dense).collect()}
    assert pool == {"a": "lexical", "b": "lexical+dense", "d": "dense"}
    for bad in ([(1, "x", "MISCONCEPTION", 1, 0.9)], [(1, "c", "MISCONCEPTION", 1, 0.9)]):
        with pytest.raises(ValueError):
            rt.card_pool(cards, ask("round"), spark.createDataFrame(bad, dense.schema))


def test_cards_are_found_by_whatever_scores(spark):
    """The keys of cards and queries meet for every pair that scores: compared with scoring all pairs."""
    r = random.Random(3)
    word = lambda: r.choice(["sum", "round", "half", "3", "12", "345", "1 2", "tutor", "student", "ratio"])
    cards = spark.createDataFrame([(f"c{i}", r.choice(["MISCONCEPTION", "TUTOR_STRATEGY"]), i, 10000 + i, " ".join(word() for _ in range(r.randint(0, 4))), " ".join(word() for _ in range(3))) for i in range(30)], "chunk_id string, card_type string, session_id long, question_id long, question_text string, searchable string")
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(1, 4)))) for i in range(20)] + [(90, "question 10003")], "query_id long, query string")
    own, q = rt._described(cards), rt._asked(asked)
    every = rt._features(own.select("chunk_id").crossJoin(q.select("query_id")), own, q).where("score > 0")
    got = rt.card_scores(cards, asked)
    assert got.count() > 50 and got.exceptAll(every).count() == 0 and every.exceptAll(got).count() == 0


def test_assembly_takes_what_covers_most(spark):
    r = random.Random(5)
    for case in range(12):
        units = []
        for rank in range(1, 7):
            s, a = r.randint(1, 2), r.randint(1, 8)
            ids = list(range(a, a + r.randint(1, 4)))
            units.append((1, f"u{rank}", rank, r.randint(10, 60), s, ids, [i for i in ids if i % 2], sorted({f"c{s}"} if any(i % 2 for i in ids) else set()), sorted({"student" if i % 2 else "tutor" for i in ids})))
        df = spark.createDataFrame(units, "query_id long, id string, rank int, tokens long, session_id long, turn_ids array<int>, parent_turns array<int>, card_ids array<string>, roles array<string>")
        budget, most = 120, 3

        def value(picked):
            places = {(u[4], t) for u in picked for t in u[5]}
            ends = set()
            for s in {u[4] for u in units}:
                own = [u for u in units if u[4] == s]
                if min(own, key=lambda u: (u[5][0], u[2])) in picked:
                    ends.add((s, 0))
                if max(own, key=lambda u: (u[5][-1], -u[2])) in picked:
                    ends.add((s, 1))
            rest = (len({(u[4], t) for u in picked for t in u[6]}), len({c for u in picked for c in u[7]}), len(places), len(ends), len({x for u in picked for x in u[8]}), -len({u[4] for u in picked}), -sum(u[2] for u in picked), tuple(-u[2] for u in picked))
            if len(ends) < 2 * len({u[4] for u in units}):
                return (False, rest)
            start = end = longest = 0
            for s in {u[4] for u in units}:
                own = {t for x, t in places if x == s}
                low, high = min(u[5][0] for u in units if u[4] == s), max(u[5][-1] for u in units if u[4] == s)
                line = [t in own for t in range(low, high + 1)]
                start += next((i for i, x in enumerate(line) if not x), len(line))
                end += next((i for i, x in enumerate(reversed(line)) if not x), len(line))
                longest += max(len(x) for x in "".join("x" if x else " " for x in line).split())
            return (True, (len(places), start, end, longest, *rest))

        tried = [c for n in range(1, most + 1) for c in combinations(units, n) if sum(u[3] for u in c) <= budget]
        want = [u[1] for u in max(tried, key=value)]
        assert [x.id for x in assembly.coverage_subset(df, budget, most).orderBy("position").collect()] == want, case
    assert [x.id for x in assembly.coverage_subset(df, 1000, 3, tries=1).orderBy("position").collect()] == ["u1", "u2", "u3"]
    assert assembly.coverage_subset(df, 1, 3).count() == 0


def test_a_writer_that_dies_loses_nothing(spark, tmp_path):
    import os

    path = f"file://{tmp_path}/rows"
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    store.write_json_lines(rows, path)
    os.rename(tmp_path / "rows", tmp_path / "rows.previous")  # it died between its renames
    assert store.read_json_lines(spark, path, rows.schema, "k").collect() == rows.collect()
    os.makedirs(tmp_path / "rows.previous")  # it died before it removed the old rows
    store.recover(spark, path)
    assert sorted(os.listdir(tmp_path)) == ["rows"]
    new = spark.createDataFrame([(2, "b")], rows.schema)
    with pytest.raises(Exception):
        store.write_json_lines(new.withColumn("v", F.raise_error(F.lit("broken"))), path)
    assert store.read_json_lines(spark, path, rows.schema, "k").collect() == rows.collect()


def test_a_failed_graph_leaves_the_ready_one(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "SESSION", "x", 1), ("b", "TURN", "y", 1)], "node_id string, node_type string, label string, source_session_id long")
    edges = spark.createDataFrame([("e", "a", "b")], "edge_id string, source_node_id string, target_node_id string")
    labels = spark.createDataFrame([("l", "a")], "assignment_id string, source_node_id string")
    g = store.GraphStore(spark, f"file://{tmp_path}/g")
    g.write("v1", "h", nodes, edges, labels, "2026-01-01 00:00:00")
    with pytest.raises(ValueError, match="dangling"):
        g.write("v1", "h", nodes.limit(1), edges, labels, "2026-01-02 00:00:00")
    assert g.open("v1", "h")["nodes"].count() == 2
    g.write("v1", "h2", nodes.union(spark.createDataFrame([("c", "TURN", "z", 2)], nodes.schema)), edges, labels, "2026-01-03 00:00:00")
    assert g.open("v1", "h2")["nodes"].count() == 3


def test_reports_snapshots_and_fetching(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    store.write_report(spark, path, "Run", {"seed": 1}, [{"metric": "m|x", "scope": "case", "status": "FAILED", "value": 0.5, "threshold": 1}, {"metric": "n", "scope": "slice", "status": "SUCCESS", "value": 1, "threshold": 1}])
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith(".")) == ["failures.jsonl", "observations.jsonl", "run.json", "slices.jsonl", "summary.md"]
    assert "| m\\|x | case | FAILED | 0.5 | 1 |" in (tmp_path / "run" / "summary.md").read_text()
    assert len((tmp_path / "run" / "failures.jsonl").read_text().splitlines()) == 1 and json.loads((tmp_path / "run" / "run.json").read_text())["seed"] == 1
    with pytest.raises(ValueError):
        store.write_report(spark, path, "Run", {}, [])
    spark.range(3).write.parquet(f"file://{tmp_path}/v")
    copy = store.snapshot(spark, f"file://{tmp_path}/v")
    spark.range(9).write.mode("overwrite").parquet(f"file://{tmp_path}/v")
    assert spark.read.parquet(copy).count() == 3

    def read(source):
        if source == "a":
            raise OSError("down")
        return b"data"

    assert store.fetch(spark, ["a", "b"], f"file://{tmp_path}/f", read) == "b" and (tmp_path / "f").read_bytes() == b"data"
    with pytest.raises(OSError, match="down"):
        store.fetch(spark, ["a"], f"file://{tmp_path}/f", read)
    tried = []

    def opener(p):
        tried.append(p)
        if len(tried) == 1:
            raise OSError("busy")
        return spark.range(2)

    assert store.open_vectors(spark, "x", 2, opener).count() == 2 and len(tried) == 2
    rows = spark.createDataFrame([(1, "a", "x", None, None, None), (1, "b", None, 2, None, None), (2, "a", None, None, None, True)], "id long, key string, string_value string, int_value long, float_value double, bool_value boolean")
    assert {r.id: r.metadata for r in store.vector_metadata(rows).collect()} == {1: {"a": "x", "b": "2"}, 2: {"a": "true"}}


def test_batches_and_gaps(spark):
    ids = list(range(0, 3000, 3))
    got = {r.id: r.batch for r in tables.batches(spark.createDataFrame([(i,) for i in ids], "id long").repartition(7), "id", 64).collect()}
    assert got == {i: n // 64 for n, i in enumerate(ids)}
    for n, size, step in ((20, 2, 5), (7, 3, 3), (9, 2, 9), (1, 4, 2)):
        assert sorted(spark.range(1).select(windows.gap_free(F.lit(n), size, step).alias("s")).first().s) == sorted(windows.gap_free_starts(n, size, step))


def test_models_that_answer_wrongly_are_told(spark):
    said = []

    def model(messages):
        said.append(len(messages))
        return "no" if len(said) < 3 else '{"a": 1}'

    assert providers.until_valid(model, [{"role": "user", "content": "q"}], lambda p: p["a"]) == 1 and said == [1, 3, 5]
    with pytest.raises(ValueError, match="2 tries"):
        providers.until_valid(lambda m: "{}", [], lambda p: p["a"], 2)
    turns = [(1, "student", "I  think 4"), (2, "tutor", "why 4")]
    good = {"misconception": {"misconception_name": "n", "deep_mechanism": "d", "verbatim_student_quotes": ["think 4"], "source_turn_ids": [1]}, "tutor_strategy": {"pedagogical_goal": "g", "strategy_category": "c", "key_aha_question": "why 4", "source_turn_ids": [2]}}
    assert providers.grounded(good, turns) == good
    for kind, name, value in (("misconception", "source_turn_ids", [2]), ("misconception", "verbatim_student_quotes", ["thought"]), ("tutor_strategy", "key_aha_question", " "), ("tutor_strategy", "source_turn_ids", [])):
        with pytest.raises(ValueError):
            providers.grounded(good | {kind: good[kind] | {name: value}}, turns)
    answer = {"primary_intent": "EXAM_ERROR_PATTERNS", "secondary_intent": None, "confidence": 0.9, "rationale": "r"}
    ask = lambda **more: router.strict_classifier(lambda m: json.dumps(answer | more), 1)("q", router.PRIORITY)
    assert ask() == ("EXAM_ERROR_PATTERNS", 0.9, None)
    for more in ({"primary_intent": "SKY"}, {"secondary_intent": "EXAM_ERROR_PATTERNS"}, {"confidence": 2}, {"confidence": True}, {"rationale": ""}, {"extra": 1}):
        with pytest.raises(ValueError):
            ask(**more)
    shown = []
    assert providers.stream_tokens(iter("abc"), shown.append) == "abc" and shown == ["a", "b", "c"]


def test_audits_add_turns_and_quotes(spark):
    turns = spark.createDataFrame([(1, 1, "student", "one"), (1, 2, "tutor", "two"), (1, 3, "student", "three"), (1, 5, "student", " one ")], "session_id long, turn_id int, speaker string, text string")
    cards = spark.createDataFrame([("c", 1, [1], ["one"])], "chunk_id string, session_id long, source_turn_ids array<int>, quotes array<string>")
    audit = lambda ids: spark.createDataFrame([("c", ids)], "chunk_id string, turn_ids array<int>")
    r = evidence.merge_audit(cards, audit([3, 5]), turns, "student").first()
    assert (r.source_turn_ids, r.quotes) == ([1, 3, 5], ["one", "three"])
    for bad in ([2], [9]):
        with pytest.raises(ValueError):
            evidence.merge_audit(cards, audit(bad), turns, "student")


def test_capabilities(spark):
    turns = spark.createDataFrame([(1, 1, "s", "t")], "Intervention_Id long, turn_id int, speaker string, text string")
    held = planner.snapshots({"turns": turns})
    assert held["DIALOGUE_EVIDENCE"].available and held["BUSINESS_ANALYTICS"].missing[:2] == ("analytics", "manifest")
    assert [s.capability for s in planner.require(["DIALOGUE_EVIDENCE"], held)] == ["DIALOGUE_EVIDENCE"]
    with pytest.raises(LookupError, match="student_key"):
        planner.require(["DIALOGUE_EVIDENCE", "RETAKE_COHORT"], planner.snapshots({"turns": turns}, {"student_features": spark.createDataFrame([], "session_id long, attempt_number int")}))
    with pytest.raises(ValueError):
        planner.require(["SKY"], held)


def test_gates_of_a_run(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id long, id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (2, "y", 1)], "query_id long, id string, relevance int")
    latency = spark.createDataFrame([(1, 100.0, "p"), (2, 400.0, "q")], "query_id long, latency_ms double, side string")
    got = {(r.scope, r.slice, r.case_id, r.metric): (r.value, r.status, r.hard_gate) for r in metrics.retrieval_gates(ranked, qrels, latency, "side").collect()}
    assert got["case", "p", 1, "recall_at_3"] == (1.0, "SUCCESS", True) and got["case", "q", 2, "recall_at_3"] == (0.0, "FAILED", True)
    assert got["aggregate", None, None, "latency_p95_ms"] == (pytest.approx(385.0), "FAILED", True) and got["slice", "p", None, "latency_p95_ms"] == (100.0, "SUCCESS", True)
    assert got["case", "p", 1, "noise_ratio_at_5"][0] == pytest.approx(0.8) and got["aggregate", None, None, "mrr"][0] == 0.5


def test_question_fragments(spark):
    one = lambda x, f: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one("导师如何 解 x？ ", tx.question_fragment) == "解 x" and one("看“A  b？”这题", tx.question_fragment) == "A  b"
    assert one(" A  b\n", tx.compact) == "ab"
