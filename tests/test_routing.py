"""Routes of tables equal those of single questions, and words are found as brute force finds them."""

import random

import pytest

from colloquy.plans import planner, router, routing

GLOSSARY = [{"keywords": ["algebra", "代数"], "subject_path": "Algebra"}, {"keywords": ["时间"], "subject_path": "Time"}, {"keywords": ["sky", "blue sky"], "subject_path": "Nature/Sky"}, {"keywords": ["equation"], "subject_path": "Algebra"}]
FIELDS = ("intent", "status", "scope", "computation", "confidence", "source", "secondary", "candidates", "filters", "tokens", "top_k", "perspectives", "ambiguous")
READY = {"BUSINESS_ANALYTICS": "AVAILABLE", "DIALOGUE_EVIDENCE": "AVAILABLE"}


#: Question, then what is known of it: intent, status, scope, computation, top, strong intents, plan, operation, session, question ids, protected tokens.
GOLD = (
    ("What are the most common student questions? top 5", "STUDENT_FREQUENT_QUESTIONS", "RESOLVED", "CORPUS", "HYBRID", 5, "STUDENT_FREQUENT_QUESTIONS", "ANALYTICS_WITH_EVIDENCE", "frequent_student_questions", None, "", "5"),
    ("Which recurring misconception is seen most?", "RECURRING_MISCONCEPTIONS", "RESOLVED", "CORPUS", "HYBRID", 3, "RECURRING_MISCONCEPTIONS", "ANALYTICS_WITH_EVIDENCE", "recurring_misconceptions", None, "", ""),
    ("Why is 3/4 + 1/2 not 4/6?", "QUESTION_TUTORING", "RESOLVED", "QUESTION", "MICRO", 3, "QUESTION_TUTORING", "SOCRATIC_TUTORING", None, None, "", "3/4 + 1/2|4/6"),
    ("谁教得最好", "UNSUPPORTED", "UNSUPPORTED", "CORPUS", "REJECT", 3, "", "REJECT", None, None, "", ""),
    ("blue sky", "UNRESOLVED", "NEED_LLM", "CORPUS", "HYBRID", 3, "", "REJECT", None, None, "", ""),
    ("misconception and strategy co-occurrence in session 17", "CONTENT_IMPROVEMENT", "RESOLVED", "QUESTION", "HYBRID", 3, "", "CONTENT_BRIEF", "misconception_strategy_pairs", 17, "", "17"),
    ("question id 12345: how do i solve it", "QUESTION_TUTORING", "RESOLVED", "QUESTION", "MICRO", 3, "QUESTION_TUTORING", "SOCRATIC_TUTORING", None, None, "12345", "12345"),
    ("what about retakers", "STUDENT_COHORT_PATTERNS", "RESOLVED", "CORPUS", "HYBRID", 3, "STUDENT_COHORT_PATTERNS", "REJECT", None, None, "", ""),
)


def vocabulary():
    o = routing.OWN
    return routing.Vocabulary(o.signals, o.strong, o.marks, o.short_strong, o.unsupported, o.elapsed, glossary=tuple((tuple(g["keywords"]), g["subject_path"]) for g in GLOSSARY))


def questions(n):
    rnd = random.Random(7)
    words = sorted({w for group in (router.SIGNALS, router.STRONG, router.MARKS) for ws in group.values() for w in ws} | set(router.SHORT_STRONG) | set(router.ELAPSED))
    other = ["3/4 + 1/2", "top 5", "TOP 50", "前7", "Session no. 17", "question id 12345", "(-q)^2", "10:12", "option B", "algebra", "时间", "blue sky", "equation", "x", "co-occurrence", "Ｆull ｗidth", "-3.5", "7", "谁教得最好"]
    return ["  ".join(rnd.choice(words).upper() if rnd.random() < 0.3 else rnd.choice(words if rnd.random() < 0.7 else other) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def expected(q, classifier=None):
    r = router.route(q, GLOSSARY, classifier=classifier)
    return {f: list(v) if isinstance(v := getattr(r, f), tuple) else v for f in FIELDS}


def test_routes_of_a_table_equal_single_routes(spark):
    asked = questions(700) + ["Which recurring misconception is seen most?", "Why is 3/4 + 1/2 not 4/6?", "blue sky", "what about retakers 提分"]
    rows = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    routed = routing.plans(routing.routes(rows, vocabulary()), READY)
    got = {r.id: r.asDict() for r in routed.collect()}
    kinds = set()
    for i, q in enumerate(asked):
        want = expected(q)
        assert {f: got[i][f] for f in FIELDS} == want, q
        p = planner.plan(router.route(q, GLOSSARY), READY)
        assert (got[i]["plan"], got[i]["operation"]) == (p.kind, p.operation), q
        assert got[i]["session"] == (None if (s := router.session_hint(q)) is None else str(s))
        assert list(map(int, got[i]["question_ids"])) == router.question_ids(q)
        assert {k: n for k, n in zip(router.PRIORITY, got[i]["points"], strict=True) if n} == router.scores(router.normal(q)), q
        assert got[i]["strong"] == list(router.strong_intents(router.normal(q))), q
        kinds.add((want["status"], want["scope"], want["computation"]))
    assert len(kinds) > 8  # the questions are of many kinds


def test_classifier_is_asked_for_open_texts_only(spark):
    def answers(q, candidates):
        if "algebra" in q:
            raise OSError
        return ("EXAM_ERROR_PATTERNS", 0.9, "DIFFICULT_CONCEPTS") if "sky" in q else ("NO_SUCH", 1.0, None)

    asked = ["blue sky", "algebra", "green", "common misconception 共性误区", *questions(60)]
    got = {r.id: r.asDict() for r in routing.routes(spark.createDataFrame(list(enumerate(asked)), "id long, text string"), vocabulary(), classifier=answers).collect()}
    for i, q in enumerate(asked):
        assert {f: got[i][f] for f in FIELDS} == expected(q, answers), q


def test_invalid_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, " \n"), (3, "x" * 2001), (4, "x" * 2000), (4, "x" * 2000)], "id long, text string")
    got = sorted((r.id, r.status) for r in routing.routes(rows).collect())
    assert got == [(1, "INVALID"), (2, "INVALID"), (3, "INVALID"), (4, "NEED_LLM"), (4, "NEED_LLM")]
    assert routing.routes(rows.where("id > 9")).count() == 0
    assert {r.id: r.status for r in routing.routes(rows, longest=None).collect()}[3] == "NEED_LLM"
    with pytest.raises(ValueError):
        routing.routes(rows.selectExpr("id", "text", "1 AS status"))


def test_finder_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        words = tuple({"".join(rnd.choices("ab", k=rnd.randint(1, 4))) for _ in range(4)})
        groups = {("signal", "x"): words, ("mark", "y"): ("a", words[0])}
        text = "".join(rnd.choices("abc", k=rnd.randint(0, 30)))
        got = routing.Finder(groups).find(text)
        for (kind, name), ws in groups.items():
            spans = [(i, i + len(w), w) for w in set(ws) for i in range(len(text)) if text.startswith(w, i)]
            own = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and o[1] - o[0] > s[1] - s[0] for o in spans)]
            want = {(w, sum(o[2] == w for o in own), min(o[0] for o in own if o[2] == w)) for w in {o[2] for o in own}}
            assert {x[2:] for x in got if x[:2] == (kind, name)} == want
            assert set(router.matched(text, ws)) == {w for w, _, _ in want}


def test_tokens_in_linear_time():
    text = "3/4 + 1/2 (a) option B 10:12 x 7 " * 20000
    assert router.protected_tokens(text) == router.protected_tokens(text[:33])


@pytest.mark.parametrize("case", GOLD, ids=lambda g: g[0])
def test_known_questions(case):
    q, intent, status, scope, computation, top, strong, kind, operation, session, ids, tokens = case
    r = router.route(q)
    p = planner.plan(r, READY)
    assert (r.intent, r.status, r.scope, r.computation, r.top_k, p.kind, p.operation) == (intent, status, scope, computation, top, kind, operation)
    assert "|".join(sorted(router.strong_intents(router.normal(q)))) == strong and router.session_hint(q) == session
    assert ("|".join(map(str, router.question_ids(q))), "|".join(router.protected_tokens(q))) == (ids, tokens)
