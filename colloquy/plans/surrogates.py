"""Sessions, turns, cards and labels derived from the test tables, in Spark and as SQL for the same tables.

The engine's relations aren't among the test tables; conversations stand for tutoring sessions: user is the
student, assistant the tutor, system is noise. Subjects, questions and card fields follow from ids and texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.taxonomy import Taxonomy
from ..operators import graph

SUBJECTS = ("Number/Rounding", "Number/Fractions", "Algebra/Equations", "Geometry / Angles")
CATEGORIES = ("Scaffolding", "Questioning", "Modelling")
#: Signals in the invented language of the test tables, for the labels of version 1.
SIGNALS = {
    "PLACE_VALUE_CONFUSION": ("whth", "eaha"),
    "ROUNDING_RULE_CONFUSION": ("ndst", "ungbe"),
    "ORDER_OF_OPERATIONS_CONFUSION": ("ouhe",),
    "FRACTION_DENOMINATOR_CONFUSION": ("stion",),
    "PROCEDURAL_ERROR": ("thed",),
    "CONCEPTUAL_ERROR": ("erre", "que"),
    "ASK_FOR_REASONING": ("why", "onth"),
    "PRESS_FOR_ACCURACY": ("accuracy", "reed"),
    "BREAK_INTO_STEPS": ("lyan", "scaff"),
    "COMPARE_OPTIONS": ("which", "revo"),
    "CHECK_UNDERSTANDING": ("model",),
    "REPEATED_ATTEMPTS": ("hehe", "still"),
    "EXPLICIT_UNCERTAINTY": ("ouou", "lich"),
    "SELF_CORRECTION": ("anan",),
}
QUESTIONS = (("REQUEST_EXPLANATION", ("why", "whth")), ("REQUEST_CONFIRMATION", ("right", "ndre")), ("ASK_NEXT_STEP", ("next", "tier")), ("COMPARE_OPTIONS", ("which",)), ("RECALL_RULE", ("rule", "inth")), ("ASK_DEFINITION", ("what is",)), ("EXPRESS_UNCERTAINTY", ("not sure",)))
TAXONOMY = Taxonomy(version="surrogate-v1", signals=SIGNALS, question_rules=QUESTIONS)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    role = F.col("role")
    return table(spark, d, "conversations").select(
        (F.col("conv_id") + 1).alias("session_id"), (F.col("turn") + 1).cast("int").alias("turn_id"),
        F.when(role == "user", "student").when(role == "assistant", "tutor").otherwise("system").alias("speaker"),
        (role == "assistant").alias("is_tutor"), "text", (role == "system").alias("is_noise"),
    )


def _pick(values: tuple[str, ...], by):
    out = F.lit(values[0])
    for i, v in enumerate(values[1:], 1):
        out = F.when(by % len(values) == i, F.lit(v)).otherwise(out)
    return out


def sessions(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    s = F.col("session_id")
    rows = t.groupBy("session_id").agg(
        F.count("*").alias("total_turns"), F.count_if(F.col("speaker") == "student").alias("student_turn_count"), F.count_if(F.col("speaker") == "tutor").alias("tutor_turn_count"),
        F.min_by("text", F.when(F.col("speaker") == "student", F.col("turn_id"))).alias("question_text"),
    )
    gate = (F.col("total_turns") >= 2) & (F.col("student_turn_count") > 0) & (F.col("tutor_turn_count") > 0)
    return rows.select("session_id", (s % 50 + 1).alias("question_id"), (s % 7).alias("tutor_id"), _pick(SUBJECTS, s).alias("subject_path"), "question_text", "total_turns", "student_turn_count", "tutor_turn_count", gate.alias("has_valid_tutoring"))


def _cards(spark: SparkSession, d: str, role: str) -> DataFrame:
    """The first and the last text of a role, all of its texts, and where they are."""
    own = turns(spark, d).where(F.col("speaker") == role)
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_id", "text"))), lambda t: t["text"]), " ")
    return own.groupBy("session_id").agg(F.min_by("text", "turn_id").alias("head"), F.max_by("text", "turn_id").alias("tail"), every.alias("every"), F.array_sort(F.collect_list("turn_id")).alias("source_turn_ids")).join(sessions(spark, d).select("session_id", "question_id", "subject_path"), "session_id")


def misconceptions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("session_id").cast("string")
    return _cards(spark, d, "student").select(F.concat(F.lit("session_"), s, F.lit("_misconception")).alias("chunk_id"), "session_id", "question_id", "subject_path", F.col("head").alias("misconception_name"), F.col("every").alias("deep_mechanism"), F.col("head").alias("quote"), "source_turn_ids")


def strategies(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("session_id")
    moves = F.when(s % 2 == 1, F.array(F.lit("Press for Accuracy"), F.lit("ask"))).otherwise(F.array(F.lit("Revoicing")))
    return _cards(spark, d, "tutor").select(F.concat(F.lit("session_"), s.cast("string"), F.lit("_tutor_strategy")).alias("chunk_id"), "session_id", "question_id", "subject_path", F.col("every").alias("pedagogical_goal"), _pick(CATEGORIES, s).alias("strategy_category"), F.col("tail").alias("key_aha_question"), moves.alias("talk_moves"), "source_turn_ids")


def projection(spark: SparkSession, d: str) -> graph.Projection:
    return graph.Projection(sessions(spark, d), misconceptions(spark, d), strategies(spark, d), turns(spark, d), TAXONOMY)


# The same as SQL.

_case = lambda values, by: "CASE " + " ".join(f"WHEN {by} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

T = """t AS (SELECT conv_id + 1 AS session_id, CAST(turn + 1 AS INTEGER) AS turn_id,
  CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'tutor' ELSE 'system' END AS speaker,
  role = 'assistant' AS is_tutor, text, role = 'system' AS is_noise FROM conversations)"""
S = f"""s AS (SELECT session_id, session_id % 50 + 1 AS question_id, session_id % 7 AS tutor_id, {_case(SUBJECTS, "session_id")} AS subject_path,
  min_by(text, turn_id) FILTER (WHERE speaker = 'student') AS question_text, count(*) AS total_turns,
  count(*) FILTER (WHERE speaker = 'student') AS student_turn_count, count(*) FILTER (WHERE speaker = 'tutor') AS tutor_turn_count FROM t GROUP BY session_id)"""
MC = """mc AS (SELECT 'session_' || a.session_id || '_misconception' AS chunk_id, a.session_id, s.question_id, s.subject_path, head AS misconception_name,
  every AS deep_mechanism, head AS quote, source_turn_ids FROM (SELECT session_id, min_by(text, turn_id) AS head, string_agg(text, ' ' ORDER BY turn_id) AS every,
  list(turn_id ORDER BY turn_id) AS source_turn_ids FROM t WHERE speaker = 'student' GROUP BY session_id) a JOIN s USING (session_id))"""
ST = f"""st AS (SELECT 'session_' || a.session_id || '_tutor_strategy' AS chunk_id, a.session_id, s.question_id, s.subject_path, every AS pedagogical_goal,
  {_case(CATEGORIES, "a.session_id")} AS strategy_category, tail AS key_aha_question,
  CASE WHEN a.session_id % 2 = 1 THEN ['Press for Accuracy', 'ask'] ELSE ['Revoicing'] END AS talk_moves, source_turn_ids
  FROM (SELECT session_id, string_agg(text, ' ' ORDER BY turn_id) AS every, max_by(text, turn_id) AS tail, list(turn_id ORDER BY turn_id) AS source_turn_ids
  FROM t WHERE speaker = 'tutor' GROUP BY session_id) a JOIN s USING (session_id))"""
CARDS = f"WITH {T}, {S}, {MC}, {ST}"


def _hit(label: str, text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x.lower()}')" for x in SIGNALS[label]) + ")"


def _first(kind: str, text: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hit(x, text)} THEN '{x}'" for x in TAXONOMY.labels[kind] if x in SIGNALS) + " ELSE 'UNCLASSIFIED' END"


def _every(kind: str, text: str) -> str:
    found = ", ".join(f"CASE WHEN {_hit(x, text)} THEN '{x}' END" for x in TAXONOMY.labels[kind] if x in SIGNALS)
    found = f"list_filter([{found}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['UNCLASSIFIED'] END"


_QUESTION = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{x}')" for x in signals) + f" THEN '{label}'" for label, signals in QUESTIONS) + " ELSE 'OTHER' END"
G = f"""g0 AS (SELECT s.*, mc.chunk_id AS mc_id, mc.misconception_name AS mc_name, mc.deep_mechanism, mc.source_turn_ids AS mc_turns, st.chunk_id AS st_id,
  st.strategy_category AS st_name, st.talk_moves AS moves, st.source_turn_ids AS st_turns, i.all_turns,
  lower(mc.misconception_name || ' ' || mc.deep_mechanism) AS mc_text, lower(st.strategy_category || ' ' || array_to_string(st.talk_moves, ' ') || ' ' || st.key_aha_question) AS st_text,
  i.session_text FROM s JOIN mc USING (session_id) JOIN st ON st.session_id = s.session_id
  JOIN (SELECT session_id, list(turn_id ORDER BY turn_id) AS all_turns, lower(string_agg(text, ' ' ORDER BY turn_id)) AS session_text FROM t GROUP BY session_id) i ON i.session_id = s.session_id),
g AS (SELECT *, regexp_replace(lower(subject_path), '\\s*/\\s*', '/') AS subject, CASE WHEN session_id % 2 = 1 THEN ['press-for-accuracy', 'questioning'] ELSE ['revoicing'] END AS move_keys,
  {_first("MISCONCEPTION", "mc_text")} AS mc_label, {_first("EXAM_ERROR", "mc_text")} AS exam_label,
  CASE WHEN contains(mc_text, 'option') THEN 'ADD_OPTION_COMPARISON' WHEN contains(mc_text, 'language') THEN 'CLARIFY_LANGUAGE' WHEN deep_mechanism <> '' THEN 'ADD worked_example' ELSE 'UNCLASSIFIED' END AS content_label,
  {_every("TUTOR_STRATEGY", "st_text")} AS st_labels, {_every("DIFFICULTY_SIGNAL", "session_text")} AS difficulty,
  'session:' || session_id AS sn, 'misconception-event:' || mc_id AS mn, 'tutor-strategy-event:' || st_id AS tn FROM g0)"""
L = f"""l0 AS (SELECT mn AS source_node_id, 'MISCONCEPTION' AS label_type, mc_label AS canonical_label, session_id AS source_session_id, mc_turns AS source_turn_ids FROM g
  UNION ALL SELECT mn, 'EXAM_ERROR', exam_label, session_id, mc_turns FROM g
  UNION ALL SELECT mn, 'CONTENT_OPPORTUNITY', content_label, session_id, mc_turns FROM g
  UNION ALL SELECT tn, 'TUTOR_STRATEGY', x, session_id, st_turns FROM (SELECT *, unnest(st_labels) AS x FROM g)
  UNION ALL SELECT sn, 'DIFFICULTY_SIGNAL', x, session_id, all_turns FROM (SELECT *, unnest(difficulty) AS x FROM g)
  UNION ALL SELECT 'turn:' || session_id || ':' || turn_id, 'QUESTION_FUNCTION', {_QUESTION}, session_id, [turn_id] FROM t WHERE speaker = 'student' AND session_id IN (SELECT session_id FROM g)),
l AS (SELECT *, sha256(source_node_id || chr(31) || label_type || chr(31) || canonical_label) AS assignment_id FROM l0)"""
N = """n AS (SELECT sn AS node_id, 'SESSION' AS node_type, 'session ' || session_id AS label, session_id, NULL AS card, all_turns AS ids FROM g
  UNION ALL SELECT 'question:' || question_id, 'QUESTION', 'question ' || question_id, session_id, NULL, all_turns FROM g
  UNION ALL SELECT 'subject:' || subject, 'SUBJECT', subject, session_id, NULL, all_turns FROM g
  UNION ALL SELECT mn, 'MISCONCEPTION_EVENT', mc_name, session_id, mc_id, mc_turns FROM g
  UNION ALL SELECT tn, 'TUTOR_STRATEGY_EVENT', st_name, session_id, st_id, st_turns FROM g
  UNION ALL SELECT 'misconception-concept:' || mc_label, 'MISCONCEPTION_CONCEPT', mc_label, session_id, NULL, mc_turns FROM g
  UNION ALL SELECT 'strategy-concept:' || x, 'STRATEGY_CONCEPT', x, session_id, NULL, st_turns FROM (SELECT *, unnest(st_labels) AS x FROM g)
  UNION ALL SELECT 'turn:' || session_id || ':' || turn_id, 'TURN', 'turn ' || turn_id, session_id, NULL, [turn_id] FROM t WHERE session_id IN (SELECT session_id FROM g)
  UNION ALL SELECT 'talk-move:' || x, 'TALK_MOVE', x, session_id, NULL, all_turns FROM (SELECT *, unnest(move_keys) AS x FROM g))"""
E = """e0 AS (SELECT 'ANCHORS' AS edge_type, sn AS a, 'question:' || question_id AS b, session_id, all_turns AS ids FROM g
  UNION ALL SELECT 'ABOUT_SUBJECT', sn, 'subject:' || subject, session_id, all_turns FROM g
  UNION ALL SELECT 'HAS_MISCONCEPTION', sn, mn, session_id, mc_turns FROM g
  UNION ALL SELECT 'HAS_STRATEGY', sn, tn, session_id, st_turns FROM g
  UNION ALL SELECT 'TYPE_OF', mn, 'misconception-concept:' || mc_label, session_id, mc_turns FROM g
  UNION ALL SELECT 'TYPE_OF', tn, 'strategy-concept:' || x, session_id, st_turns FROM (SELECT *, unnest(st_labels) AS x FROM g)
  UNION ALL SELECT 'CO_OCCURS_WITH', mn, tn, session_id, list_sort(list_distinct(list_concat(mc_turns, st_turns))) FROM g
  UNION ALL SELECT 'EVIDENCED_BY', mn, 'turn:' || session_id || ':' || x, session_id, [x] FROM (SELECT *, unnest(mc_turns) AS x FROM g)
  UNION ALL SELECT 'EVIDENCED_BY', tn, 'turn:' || session_id || ':' || x, session_id, [x] FROM (SELECT *, unnest(st_turns) AS x FROM g)
  UNION ALL SELECT 'HAS_TURN', sn, 'turn:' || session_id || ':' || x, session_id, [x] FROM (SELECT *, unnest(all_turns) AS x FROM g)
  UNION ALL SELECT 'USES_TALK_MOVE', tn, 'talk-move:' || x, session_id, st_turns FROM (SELECT *, unnest(move_keys) AS x FROM g)),
e AS (SELECT *, 'edge:' || sha256(edge_type || chr(31) || a || chr(31) || b) AS edge_id FROM e0)"""
GRAPH = f"{CARDS}, {G}, {L}, {N}, {E}"


def windows_sql(size: int, step: int, stop: bool = True, name: str = "w") -> str:
    """Windows of t by position, with the stop at a session's end or without."""
    last = f"CAST(ceil(greatest(n - {size}, 0) / {step}.0) AS BIGINT) * {step}" if stop else "n - 1"
    return f"""{name}p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n FROM t),
{name}s AS (SELECT session_id, unnest(range(0, {last} + 1, {step})) AS start FROM (SELECT DISTINCT session_id, n FROM {name}p)),
{name} AS (SELECT p.session_id, s.start, min(turn_id) AS first_turn, max(turn_id) AS last_turn, list(turn_id ORDER BY turn_id) AS ids,
  string_agg('[Turn ' || turn_id || '] ' || speaker || ': ' || text, chr(10) ORDER BY turn_id) AS content
  FROM {name}p p JOIN {name}s s ON p.session_id = s.session_id AND p.pos >= s.start AND p.pos < s.start + {size} GROUP BY p.session_id, s.start)"""
