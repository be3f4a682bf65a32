"""Three sessions with answers counted by hand."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import analytics as an

SESSIONS = [(1, "Number"), (2, "Number"), (3, "Algebra")]
ROWS = {
    "QUESTION_FUNCTION": {"REQUEST_EXPLANATION": [1, 2], "UNCLASSIFIED": [3]},
    "MISCONCEPTION": {"PLACE_VALUE_CONFUSION": [1, 2, 2], "UNCLASSIFIED": [3]},
    "EXAM_ERROR": {"PROCEDURAL_ERROR": [1, 2]},
    "TUTOR_STRATEGY": {"ASK_FOR_REASONING": [1, 2], "USE_COUNTER_EXAMPLE": [3]},
    "CONTENT_OPPORTUNITY": {"ADD_worked_example": [1, 2]},
    "DIFFICULTY_SIGNAL": {"REPEATED_ATTEMPTS": [1]},
}


@pytest.fixture(scope="module")
def tables(spark):
    labels = [(f"n{k}{i}{s}", kind, name, s, [1, 2]) for k, (kind, names) in enumerate(ROWS.items()) for name, ids in names.items() for i, s in enumerate(ids)]
    return (
        spark.createDataFrame(labels, "source_node_id string, label_type string, canonical_label string, source_session_id long, source_turn_ids array<int>"),
        spark.createDataFrame(SESSIONS, "session_id long, subject_path string"),
        spark.createDataFrame([(s, t, w, f"{w} {s}") for s, _ in SESSIONS for t, w in ((1, "student"), (2, "tutor"))], "session_id long, turn_id int, speaker string, text string"),
    )


def test_most_frequent_question(tables):
    r = an.run("frequent_student_questions", *tables)
    assert r.status == "MEASURED"
    assert (r.rows[0]["event_count"], r.rows[0]["distinct_session_count"]) == (2, 2)
    assert r.rows[0]["session_share"] == pytest.approx(2 / 3)


def test_unclassified_is_shown_and_scope_names_unmeasured(tables):
    r = an.run("recurring_misconceptions", *tables)
    assert "UNCLASSIFIED" in [x["canonical_name"] for x in r.rows]
    assert r.unmeasured == ("UNRESOLVED_ENDING",)


def test_filter_is_never_code(tables):
    r = an.run("tutor_strategy_patterns", *tables, filters=["Number' OR 1=1 --"])
    assert (r.rows, r.status, r.matched_sessions) == ([], "NO_MATCHING_SCOPE", 0)


def test_no_label_of_a_type_is_no_evidence(tables):
    labels, sessions, turns = tables
    r = an.run("exam_error_patterns", labels.where("label_type <> 'EXAM_ERROR'"), sessions, turns, filters=["Number"])
    assert (r.status, r.matched_sessions) == ("NO_EVIDENCE", 2)
    assert an.run("exam_error_patterns", labels, sessions.where("false"), turns).status == "NO_EVIDENCE"


def test_pair_counts_are_products(tables):
    top = an.pairs(*tables[:2], 1).first()
    assert (top.relation, top.distinct_session_count, top.event_count) == ("CO_OCCURS_WITH", 2, 3)


def test_priority(tables):
    top = an.content_opportunities(*tables[:2]).first()
    assert (top.missing_content_flag, top.repeated_error_count) == (1, 3)
    assert top.priority_score == pytest.approx(2)


def test_references_hold_one_role(tables):
    r = an.run("recurring_misconceptions", *tables)
    assert r.refs and all(x["turn_ids"] == [1] for x in r.refs)
    assert all(x["turn_ids"] == [2] for x in an.run("tutor_strategy_patterns", *tables).refs)


def test_a_first_node_without_the_role_gives_no_reference(spark, tables):
    labels = spark.createDataFrame([("a", "MISCONCEPTION", "X", 1, [2]), ("b", "MISCONCEPTION", "X", 1, [1])], tables[0].drop("x").select("source_node_id", "label_type", "canonical_label", "source_session_id", "source_turn_ids").schema)
    ranked = an.rank_labels(labels, tables[1], "MISCONCEPTION")
    assert an.representatives(labels, ranked, tables[1], tables[2], "MISCONCEPTION", "student").count() == 0


def test_top_k_is_checked(tables):
    with pytest.raises(ValueError):
        an.rank_labels(*tables[:2], "MISCONCEPTION", 0)


def test_like_keeps_its_signs(tables):
    assert tables[1].where(an.like_all("subject_path", ["N%r"])).count() == 2
    assert tables[1].where(an.contains_any("subject_path", ["N%r"])).count() == 0
    assert tables[1].where(F.lit(True) & an.contains_any("subject_path", [])).count() == 3
