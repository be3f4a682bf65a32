"""Questions end to end over three sessions, and what surrounds an answer."""

import pytest

from colloquy.operators import windows
from colloquy.plans import answer

from .test_analytics import ROWS, SESSIONS


@pytest.fixture(scope="module")
def tables(spark):
    labels = [(f"n{k}{i}{s}", kind, name, s, [1, 2]) for k, (kind, names) in enumerate(ROWS.items()) for name, ids in names.items() for i, s in enumerate(ids)]
    return {
        "labels": spark.createDataFrame(labels, "source_node_id string, label_type string, canonical_label string, source_session_id long, source_turn_ids array<int>"),
        "sessions": spark.createDataFrame(SESSIONS, "session_id long, subject_path string"),
        "turns": spark.createDataFrame([(s, t, w, w) for s, _ in SESSIONS for t, w in ((1, "student"), (2, "tutor"))], "session_id long, turn_id int, speaker string, text string"),
    }


def test_a_macro_question(tables):
    a = answer.ask("Which recurring misconception is seen most? top 1", tables)
    assert (a.status, len(a.rows), a.rows[0]["canonical_name"]) == ("MEASURED", 1, "PLACE_VALUE_CONFUSION")
    assert "PLACE_VALUE_CONFUSION" in a.prompt and "UNRESOLVED_ENDING" in a.prompt and a.refs


def test_filters_count_only_for_subjects(tables):
    glossary = [{"keywords": ["algebra"], "subject_path": "Algebra"}]
    assert answer.ask("common misconception in algebra", tables, glossary).rows[0]["canonical_name"] == "UNCLASSIFIED"


def test_open_and_unsupported_questions(tables):
    assert answer.ask("blue sky", tables).status == "UNMEASURED"
    assert answer.ask("谁教得最好", tables).status == "REJECTED"
    assert answer.ask("common misconception", {"turns": tables["turns"]}).plan.reason.startswith("BUSINESS_ANALYTICS")


def test_payloads():
    catalog = {"E001": "student", "E002": "tutor"}
    got = answer.canonical_payload({"citations": ["E1"], "claims": [{"evidence_ids": ["E002", "E1"]}]}, catalog)
    assert (got["citations"], got["student_ids"], got["tutor_ids"]) == (["E001", "E002"], ["E001"], ["E002"])
    with pytest.raises(ValueError):
        answer.canonical_payload({"citations": ["E9"]}, catalog)


def test_judgement_and_slots():
    assert answer.judge(lambda: 0.5, lambda: 0.1, 1.0)["source"] == "judge"
    assert answer.judge(None, lambda: 0.1, None, True)["score"] == 0.1
    with pytest.raises(ValueError):
        answer.judge(None, lambda: 0.1, None)
    text = answer.card_context({"name": "x", "empty": ""}, None, [{"evidence_id": "E001", "speaker": "student", "text": "t"}])
    assert "name: x" in text and "empty" not in text and "## Strategy\nnone" in text and "[E001] student: t" in text


def test_chunk_strategies(spark):
    w, c = (spark.createDataFrame([(x, x)], "chunk_id string, content string") for x in "wc")
    count = lambda s, cards: (windows.chunks(s, w, cards)[0].count(), windows.chunks(s, w, cards)[1] is not None)
    assert [count("primary", c), count("fallback", None), count("hybrid", c), count("hybrid", None)] == [(1, False), (1, False), (2, False), (1, True)]
    for s, cards in (("primary", None), ("other", c)):
        with pytest.raises(ValueError):
            windows.chunks(s, w, cards)
