"""Small cases of text, ETL, windows, graph, retrieval, audits, metrics, sources and plans."""

import math
import os

import pytest
from pyspark.sql import functions as F

from colloquy.functions import scoring as sc, text as tx
from colloquy.functions.taxonomy import Taxonomy
from colloquy.operators import assembly, etl, evidence, graph, metrics, retrieval as rt, windows
from colloquy.plans import planner, router
from colloquy.sources import store, tables


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_cleaning_keeps_formulas_and_hides_names(spark):
    text = r"Hi Sophie, my name is Alex  Smith. Solve \(x  +  1\) and $y$. Call 555-123-4567 or a.b@c.org" + "\n\n\nbye"
    got = one(spark, text, lambda c: tx.clean(c)["text"])
    assert r"\(x  +  1\)" in got and "$y$" in got
    assert "Alex" not in got and "Sophie" not in got and "[PHONE_NUMBER]" in got and "[EMAIL]" in got and "\n\n" not in got
    assert one(spark, None, lambda c: tx.clean(c)["is_noise"])


@pytest.mark.parametrize("text,noise", [("Hello!", True), ("ok", True), ("thx so much", True), ("why is it 4", False), ("", True)])
def test_greetings(spark, text, noise):
    assert one(spark, text, tx.is_greeting) == noise
    assert one(spark, text, lambda c: tx.clean(c)["is_noise"]) == noise


def test_canonical_evidence(spark):
    assert one(spark, "  ‘ﬁne’ —​ ok… 🙂", tx.canonical_pandas) == "'fine' - ok..."


def test_tokens_numbers_estimates(spark):
    assert one(spark, "It's 3.5 的x Gr_ö1", tx.tokens) == ["it's", "3.5", "的", "x", "gr", "ö", "1"]
    assert one(spark, "−3 and 1/2 and 2.5", tx.numbers) == ["-3", "1/2", "2.5"]
    assert one(spark, "one two three 的", tx.token_estimate_words) == 4
    assert one(spark, "", tx.token_estimate_mixed) == 1
    assert one(spark, "code 12 345 and 7", tx.signatures) == ["12345"]


def test_keys(spark):
    assert one(spark, " Number /  Angles", tx.subject_key) == "number/angles"
    assert one(spark, "Press_for-accuracy", tx.talk_move_key) == "press-for-accuracy"
    assert one(spark, "Ask", tx.talk_move_key) == "questioning"
    assert one(spark, "A & B!", tx.slug) == "a-b"


RAW = [(1, 9, 5, 1, 0, "hi", None), (1, 9, 5, 2, 0, "stuck", "<None>"), (1, 9, 5, 3, 1, "why?", "Press"), (1, 9, 5, 4, 1, "try", "Press"), (1, 9, 5, 5, 0, "ok", "nan"), (2, 8, 6, 1, 1, None, "Ask")]


@pytest.fixture(scope="module")
def dialogues(spark):
    return spark.createDataFrame(RAW, store.RAW["dialogues"])


def test_turns_are_runs_of_a_speaker(dialogues):
    rows = etl.compress_turns(dialogues).orderBy("session_id", "turn_id").collect()
    assert [(r.session_id, r.turn_id, r.speaker, r.raw_messages, r.talk_moves) for r in rows] == [
        (1, 1, "student", ["hi", "stuck"], []), (1, 2, "tutor", ["why?", "try"], ["Press"]), (1, 3, "student", ["ok"], []), (2, 1, "tutor", [""], ["Ask"])]
    assert {r.session_id: r.has_valid_tutoring for r in etl.session_counts(etl.compress_turns(dialogues)).collect()} == {1: True, 2: False}


def test_question_pivot(spark):
    rows = [(9, 1, 1, "b", 2, 1, "Question Text"), (9, 1, 1, "a", 1, 1, "Question Text"), (9, 1, 1, "old", 3, 1, "Answer A Text"), (9, 1, 1, "new", 4, 1, "Answer A Text"), (9, 1, 1, "u", 5, 1, "Answer B Image"), (9, 1, 1, "q", 6, 1, "Question Image")]
    r = etl.pivot_questions(spark.createDataFrame(rows, store.RAW["question_metadata"])).first()
    assert (r.question_text, r.options, r.images) == ("a\nb", {"A": "new"}, {"B": "u", "Question": "q"})


def test_subject_paths_fall_back(spark):
    rows = [(1, 32, None, "Number", 1, "s"), (1, 141, 32, "Rounding", 2, "s"), (1, 214, 141, "Places", 3, "s"), (1, 215, 99, "Lost", 3, "s"), (2, 5, None, "Algebra", 1, "s"), (2, 6, 77, "Lines", 2, "s"), (3, 7, None, "Data", 1, "s")]
    got = {r.InterventionId: r.paths for r in etl.subject_paths(spark.createDataFrame(rows, store.RAW["subjects"])).collect()}
    assert got == {1: ["Number > Rounding > Places", "General > Lost"], 2: ["General > Lines"], 3: ["Data"]}


def test_fusion_keeps_sessions_without_other_sides(spark, dialogues):
    out = etl.fuse(dialogues, spark.createDataFrame([], store.RAW["subjects"]), spark.createDataFrame([], store.RAW["question_metadata"]))
    assert {(r.session_id, r.question_id, r.subject_path) for r in out.collect()} == {(1, 9, None), (2, 8, None)}


def starts(n, size, step):
    out, at = [], 0
    while at < n:
        out.append(at)
        if at + size >= n:
            break
        at += step
    return out


@pytest.mark.parametrize("n", range(1, 15))
def test_windows_stop_at_the_end(spark, n):
    turns = spark.createDataFrame([(1, t + 1, "student", "x") for t in range(n)], "session_id long, turn_id int, speaker string, text string")
    got = sorted(r.start for r in windows.sliding_windows(turns, 6, 3).collect())
    assert got == starts(n, 6, 3)
    assert sorted(r.start for r in windows.sliding_windows(turns, 7, 3, False).collect()) == list(range(0, n, 3))


def test_gaps_are_filled():
    for n, size, step in ((20, 2, 5), (7, 3, 3), (0, 2, 2), (9, 2, 9)):
        covered = {i for s in windows.gap_free_starts(n, size, step) for i in range(s, s + size)}
        assert set(range(n)) <= covered


def test_taxonomy_order(spark):
    t = Taxonomy()
    assert one(spark, "round the digit", lambda c: t.first("MISCONCEPTION", c)) == "PLACE_VALUE_CONFUSION"
    assert one(spark, "none", lambda c: t.first("MISCONCEPTION", c)) == "UNCLASSIFIED"
    assert one(spark, "why? check a step", lambda c: t.every("TUTOR_STRATEGY", c)) == ["ASK_FOR_REASONING", "PRESS_FOR_ACCURACY", "BREAK_INTO_STEPS"]
    assert one(spark, "anything", lambda c: t.first("EXAM_ERROR", c)) == "UNCLASSIFIED"
    assert one(spark, "is this right, why", t.question_function) == "REQUEST_EXPLANATION"


def test_graph_checks(spark):
    nodes = spark.createDataFrame([("session:1", "SESSION", "a", 1), ("session:1", "SESSION", "b", 2), ("question:1", "QUESTION", "q", 1), ("question:1", "QUESTION", "q", 2)], "node_id string, node_type string, label string, source_session_id long")
    assert [r.node_id for r in graph.illegal_duplicates(nodes).collect()] == ["session:1"]
    edges = spark.createDataFrame([("e", "session:1", "gone")], "edge_id string, source_node_id string, target_node_id string")
    assert graph.dangling(edges, nodes).collect() == [("e", "target")]
    assert {r.node_id for r in graph.orphans(nodes, edges).collect()} == {"question:1"}
    a = graph.fingerprint(nodes, ["node_id", "label"]).first()
    assert a == graph.fingerprint(nodes.repartition(3), ["node_id", "label"]).first() != graph.fingerprint(nodes.limit(2), ["node_id", "label"]).first()


def test_bm25_against_a_plain_count(spark):
    docs = {1: "round the number", 2: "the angle the angle", 3: "volume"}
    q = "The number angle angle"
    df = spark.createDataFrame(list(docs.items()), "id long, document string")
    got = {r.id: r.bm25 for r in rt.bm25(df, spark.createDataFrame([(7, q)], "query_id long, query string")).collect()}
    mean = sum(len(d.split()) for d in docs.values()) / 3
    want = {}
    for i, d in docs.items():
        words = d.split()
        for term in {"the", "number", "angle"}:
            n = sum(term in x.split() for x in docs.values())
            tf = words.count(term)
            if tf:
                want[i] = want.get(i, 0) + math.log(1 + (3 - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    with pytest.raises(ValueError):
        rt.bm25(df, df, k1=0)


def test_scores(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(sc.cosine(a, a).alias("s"), sc.cosine(a, b).alias("z"), sc.cosine(a, F.array(F.lit(1.0))).alias("m"), sc.distance_similarity(sc.euclidean(a, F.array(F.lit(1.0)))).alias("d")).first()
    assert tuple(r) == (1.0, 0.0, 0.0, 0.0)


def test_metadata_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    n = lambda w: df.where(rt.metadata_matches({"k": F.col("k")}, w)).count()
    assert [n({"k": "a"}), n({"k": {"$in": ["a", "b"]}}), n({"k": {"$ne": "a"}}), n({"k": {"$gt": "a"}}), n({"other": None}), n({"other": "x"})] == [1, 2, 2, 3, 3, 0]


def test_fusion_and_parents(spark):
    lanes = spark.createDataFrame([(1, "a", "x", 1, 0.9), (1, "a", "y", 2, 0.8), (1, "b", "y", 1, 0.1), (1, "b", "z", 2, 0.05)], "query_id long, lane string, id string, rank int, score double")
    f = {r.id: r.rrf for r in rt.fuse(lanes).collect()}
    assert f["y"] == pytest.approx(1 / 62 + 1 / 61)
    assert [r.id for r in rt.fuse_raw_first(lanes, "a").orderBy("position").collect()] == ["x", "y", "z"]
    assert [(r.lane, r.id) for r in rt.parents(lanes, 3).orderBy("position").collect()] == [("a", "x"), ("b", "y"), ("a", "y")]


def test_budgets(spark):
    rows = [(1, "a", 1, 50, ["1:1", "1:2"]), (1, "b", 2, 10, ["1:2"]), (1, "c", 3, 60, ["1:3"]), (1, "d", 4, 40, ["1:4"])]
    units = spark.createDataFrame(rows, "query_id long, id string, rank int, tokens long, turn_keys array<string>")
    assert [r.id for r in assembly.greedy_budget(units, 100, 5).orderBy("position").collect()] == ["a", "d"]
    assert {r.id for r in assembly.best_subset(units, 110, 3).collect()} == {"a", "d"}


def test_card_validation(spark):
    turns = spark.createDataFrame([(1, 1, "student", "I  think 4"), (1, 2, "tutor", "why")], "session_id long, turn_id int, speaker string, text string")
    sessions = spark.createDataFrame([(1, 5)], "session_id long, question_id long")
    rows = [("ok", 1, 5, "I think", [1]), ("q", 1, 5, "I thought", [1]), ("r", 1, 5, "why", [2]), ("m", 1, 5, "x", [9]), ("s", 7, 5, "x", [1]), ("n", 1, 5, "x", []), ("w", 1, 6, "I think", [1])]
    cards = spark.createDataFrame(rows, "chunk_id string, session_id long, question_id long, quote string, source_turn_ids array<int>")
    got = {r.chunk_id: r.reason for r in evidence.validate_cards(cards, turns, sessions, "student", "quote").collect()}
    assert got == {"q": "QUOTE_NOT_VERBATIM", "r": "WRONG_ROLE", "m": "MISSING_TURN", "s": "NO_SESSION", "n": "NO_POINTERS", "w": "WRONG_QUESTION"}


def test_forged_evidence_is_rejected(spark):
    turns = spark.createDataFrame([(1, 1, "student", "a"), (1, 2, "tutor", "b")], "session_id long, turn_id int, speaker string, text string")
    events = spark.createDataFrame([("e1", 1, [1, 2])], "node_id string, source_session_id long, source_turn_ids array<int>")
    refs = spark.createDataFrame([("e1", 1, [1, 2]), ("e1", 2, [1]), ("e2", 1, [1]), ("e1", 1, [1, 3])], "source_event_id string, session_id long, turn_ids array<int>")
    assert [tuple(r) for r in graph.verify_evidence(refs, events, turns, "student").collect()] == [("E001", 1, 1, "student", "a")]


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "d", 1)], "query_id long, id string, relevance int")
    r = metrics.ranking(ranked, qrels, 3).first()
    assert (r.recall, r.precision, r.reciprocal_rank) == (0.5, pytest.approx(1 / 3), 0.5)
    assert r.ndcg == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))


def test_unmeasured_is_counted_not_defaulted(spark):
    o = spark.createDataFrame([("m", None, None), ("m", 1.0, True)], "metric string, value double, passed boolean")
    r = metrics.roll_up(o, ["metric"]).first()
    assert (r.value, r.cases, r.unmeasured, r.passed) == (1.0, 1, 1, 1)


def test_json_lines_and_store(spark, tmp_path):
    schema = "session_id long, name string"
    rows = spark.createDataFrame([(2, "b"), (1, None)], schema)
    path = f"file://{tmp_path}/s"
    store.write_json_lines(rows, path)
    store.write_json_lines(rows, path)
    assert [r.session_id for r in store.read_json_lines(spark, path, rows.schema, "session_id").collect()] == [1, 2]
    store.write_json_lines(rows.unionByName(rows), path)
    with pytest.raises(ValueError):
        store.read_json_lines(spark, path, rows.schema, "session_id")
    (tmp_path / "bad.json").write_text('{"session_id": 1}\n{oops\n')
    with pytest.raises(Exception):
        store.read_json_lines(spark, f"file://{tmp_path}/bad.json", rows.schema, "session_id").collect()


def test_graph_store(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "SESSION", "x", 1), ("b", "TURN", "y", 1)], "node_id string, node_type string, label string, source_session_id long")
    edges = spark.createDataFrame([("e", "a", "b")], "edge_id string, source_node_id string, target_node_id string")
    labels = spark.createDataFrame([("l", "a")], "assignment_id string, source_node_id string")
    g = store.GraphStore(spark, f"file://{tmp_path}/g")
    g.write("v1", "h", nodes, edges, labels, "2026-01-01 00:00:00")
    assert [r.node_id for r in g.open("v1", "h")["nodes"].collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="another source"):
        g.open("v1", "other")
    with pytest.raises(ValueError, match="dangling"):
        g.write("v2", "h", nodes.limit(1), edges, labels, "2026-01-01 00:00:00")
    with pytest.raises(ValueError, match="ready"):
        g.open("v2", "h")
    full = store.add_provenance(labels, nodes.withColumn("source_turn_ids", F.array(F.lit(1))))
    assert full.first().source_session_id == 1


def test_raw_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('InterventionId,QuestionId_DQ,UserId,MessageSequence,IsTutor,MessageString,TalkMovePrediction\n1,2,3,1,0,"two\nlines ""x""",\n')
    r = store.read_raw(spark, f"file://{tmp_path}/d.csv", "dialogues").first()
    assert (r.TutorId, r.MessageString, r.TalkMovePrediction) == (3, 'two\nlines "x"', None)


def test_work_list_and_batches(spark):
    cur = spark.createDataFrame([(1, "h1", "c"), (2, "h2", "c")], "k long, content_hash string, contract_hash string")
    state = spark.createDataFrame([(1, "h1", "c", "SUCCESS"), (2, "h2", "c", "FAILED")], "k long, content_hash string, contract_hash string, status string")
    assert {r.k: r.action for r in tables.work_list(cur, state, "k").collect()} == {1: "REUSE", 2: "WORK"}
    assert {r.action for r in tables.work_list(cur, state, "k", "full").collect()} == {"WORK"}
    assert sorted(tuple(r) for r in tables.batches(spark.range(5), "id", 2).collect()) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


@pytest.mark.parametrize("query,intent,status,scope", [
    ("What are the most common student questions? top 5", "STUDENT_FREQUENT_QUESTIONS", "RESOLVED", "CORPUS"),
    ("Which recurring misconception is seen most?", "RECURRING_MISCONCEPTIONS", "RESOLVED", "CORPUS"),
    ("Why is 3/4 + 1/2 not 4/6?", "QUESTION_TUTORING", "RESOLVED", "QUESTION"),
    ("谁教得最好", "UNSUPPORTED", "UNSUPPORTED", "CORPUS"),
    ("blue sky", "UNRESOLVED", "NEED_LLM", "CORPUS"),
])
def test_routes(query, intent, status, scope):
    r = router.route(query)
    assert (r.intent, r.status, r.scope) == (intent, status, scope)


def test_route_details():
    assert router.protected_tokens("Is (-q)^2 = 5/7-1/4 at 10:12, option B?") == ["(-q)^2", "5/7-1/4", "10:12", "option B"]
    assert router.requested_top("top 50 errors") == 10
    assert router.route("blue sky", classifier=lambda q, c: ("EXAM_ERROR_PATTERNS", 0.9, None)).intent == "EXAM_ERROR_PATTERNS"

    def fails(q, c):
        raise OSError

    assert router.route("blue sky", classifier=fails).status == "UNMEASURED"
    with pytest.raises(ValueError):
        router.route(" ")


def test_plans(spark):
    ready = {"BUSINESS_ANALYTICS": "AVAILABLE", "DIALOGUE_EVIDENCE": "AVAILABLE"}
    assert planner.plan(router.route("recurring misconception and strategy co-occurrence"), ready).operation == "misconception_strategy_pairs"
    assert planner.plan(router.route("what about retakers"), ready).reason == "NO_COHORT_DATA"
    assert planner.plan(router.route("common misconception"), {}).kind == "REJECT"
    got = planner.inspect({"turns": spark.createDataFrame([], "session_id long, turn_id int, speaker string, text string"), "labels": spark.range(1)})
    assert got == {"BUSINESS_ANALYTICS": "MISSING_COLUMNS", "DIALOGUE_EVIDENCE": "EMPTY", "STUDENT_COHORT": "MISSING_TABLE"}
    assert planner.public_status({"a": "MEASURED", "b": "NO_EVIDENCE"}) == "NO_EVIDENCE"
    w = planner.rewrite("round 3.5", [{"keywords": ["round"], "subject_path": "Number"}])
    assert w["raw"] == "round 3.5" and "3.5" in w["strategy"] and "Number" in w["curriculum"]


def test_streamed_turns_equal_batch_turns(spark, tmp_path):
    from colloquy.streaming import ingest

    schema = "session_id long, seq long, speaker string"
    for n, rows in enumerate(([(1, 1, "student"), (1, 2, "student")], [(1, 3, "tutor"), (1, 4, "student"), (1, 5, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/b{n}")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    q = ingest.stream_turns(src).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.turn_id, r.speaker, r.messages) for r in spark.sql("select * from closed").collect())
    assert got == [(1, "student", 2), (2, "tutor", 1), (3, "student", 1)]


def test_streamed_upsert(spark, tmp_path):
    from colloquy.streaming import ingest

    schema = "k long, v string"
    for n, rows in enumerate(([(1, "a"), (2, "a")], [(2, "b")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/b{n}")
        q = ingest.upsert_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", ["k"], f"file://{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
    last = sorted(os.listdir(tmp_path / "out"))[-1]
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out/{last}").collect()} == {(1, "a"), (2, "b")}
