"""Macro analytics over label assignments: ranked labels, pairs, priorities, representatives, scope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Measures that no operator computes; results name them rather than give a default.
UNMEASURED = ("UNRESOLVED_ENDING",)
OPERATIONS = {
    "frequent_student_questions": ("QUESTION_FUNCTION", "student"),
    "difficult_concepts": ("DIFFICULTY_SIGNAL", "student"),
    "recurring_misconceptions": ("MISCONCEPTION", "student"),
    "exam_error_patterns": ("EXAM_ERROR", "student"),
    "tutor_strategy_patterns": ("TUTOR_STRATEGY", "tutor"),
}


def like_all(column: str, filters: list[str]) -> Column:
    """All filters as patterns within the column; % and _ in a filter keep their meaning."""
    out = F.lit(True)
    for v in filters:
        out = out & F.col(column).like(f"%{v}%")
    return out


def contains_any(column: str, filters: list[str]) -> Column:
    """Any filter as plain text within the column; no filters let all pass."""
    out = F.lit(not filters)
    for v in filters:
        out = out | F.contains(F.col(column), F.lit(v))
    return out


def scoped(sessions: DataFrame, filters: list[str]) -> DataFrame:
    return sessions.where(like_all("subject_path", filters)).select("session_id").distinct()


def scope_counts(sessions: DataFrame, filters: list[str]) -> DataFrame:
    """total_sessions, matched_sessions."""
    return sessions.agg(F.count_distinct("session_id").alias("total_sessions"), F.count_distinct(F.when(like_all("subject_path", filters), F.col("session_id"))).alias("matched_sessions"))


def _in_scope(labels: DataFrame, sessions: DataFrame, filters: list[str]) -> DataFrame:
    # a semi-join, not a list of ids; the optimiser broadcasts the scope if it is small
    return labels.join(scoped(sessions, filters).withColumnRenamed("session_id", "source_session_id"), "source_session_id", "left_semi")


def _ranked(rows: DataFrame, order: list, k: int | None) -> DataFrame:
    top = rows.orderBy(*order).limit(k) if k else rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_labels(labels: DataFrame, sessions: DataFrame, label_type: str, top_k: int = 3, filters: list[str] | None = None) -> DataFrame:
    """rank, canonical_name, event_count, distinct_session_count, session_share of a type's labels, commonest first.

    Shares are of the sessions in scope; distinct counts are exact. The k rows are few, so their rank is one task's.
    """
    if top_k < 1:
        raise ValueError("top_k must be positive")
    filters = filters or []
    rows = _in_scope(labels.where(F.col("label_type") == label_type), sessions, filters)
    counted = rows.groupBy(F.col("canonical_label").alias("canonical_name")).agg(F.count("*").alias("event_count"), F.count_distinct("source_session_id").alias("distinct_session_count"))
    order = [F.desc("distinct_session_count"), F.desc("event_count"), F.asc("canonical_name")]
    total = scope_counts(sessions, filters).select("matched_sessions")
    top = _ranked(counted, order, top_k).join(F.broadcast(total))  # one row
    return top.select("rank", "canonical_name", "event_count", "distinct_session_count", (F.col("distinct_session_count") / F.col("matched_sessions")).alias("session_share"))


def pairs(labels: DataFrame, sessions: DataFrame, top_k: int | None = 3, filters: list[str] | None = None, left: str = "MISCONCEPTION", right: str = "TUTOR_STRATEGY") -> DataFrame:
    """Labels of two types in the same sessions: their event_count is the product within a session.

    Each side is counted by session and label first, so the join is of distinct labels, and a session with
    many equal labels doesn't multiply rows.
    """
    filters = filters or []
    own = lambda kind, name: _in_scope(labels.where(F.col("label_type") == kind), sessions, filters).groupBy("source_session_id", F.col("canonical_label").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    both = own(left, "misconception").join(own(right, "strategy"), "source_session_id")
    counted = both.groupBy("misconception", "strategy").agg(F.sum(F.col("n_misconception") * F.col("n_strategy")).alias("event_count"), F.count("*").alias("distinct_session_count"))
    total = scope_counts(sessions, filters).select("matched_sessions")
    order = [F.desc("distinct_session_count"), F.desc("event_count"), F.asc("misconception"), F.asc("strategy")]
    top = _ranked(counted, order, top_k).join(F.broadcast(total))  # one row
    return top.select("rank", "misconception", "strategy", F.lit("CO_OCCURS_WITH").alias("relation"), "event_count", "distinct_session_count", (F.col("distinct_session_count") / F.col("matched_sessions")).alias("session_share"))


def content_opportunities(labels: DataFrame, sessions: DataFrame, top_k: int = 3, filters: list[str] | None = None) -> DataFrame:
    """Misconceptions by priority: events times the share of sessions without them, and one more where content is missing."""
    filters = filters or []
    ranked = rank_labels(labels, sessions, "MISCONCEPTION", 1000, filters)
    wanting = _in_scope(labels.where("label_type = 'CONTENT_OPPORTUNITY'"), sessions, filters).select("source_session_id").distinct()
    flagged = _in_scope(labels.where("label_type = 'MISCONCEPTION'"), sessions, filters).join(wanting, "source_session_id", "left_semi").select(F.col("canonical_label").alias("canonical_name"), F.lit(1).alias("flag")).distinct()
    rows = ranked.drop("rank").join(flagged, "canonical_name", "left").withColumn("missing_content_flag", F.coalesce("flag", F.lit(0))).drop("flag")
    rows = rows.withColumn("repeated_error_count", F.col("event_count")).withColumn("priority_score", F.col("event_count") * (1 - F.col("session_share")) + F.col("missing_content_flag"))
    return _ranked(rows, [F.desc("priority_score"), F.asc("canonical_name")], top_k)


def representatives(labels: DataFrame, ranked: DataFrame, sessions: DataFrame, turns: DataFrame, label_type: str, role: str, filters: list[str] | None = None) -> DataFrame:
    """source_event_id, session_id, subject_path, turn_ids of one reference a session for the ranked labels.

    The first node of a session is its reference, before roles are looked at: a session whose first node has no
    turn of the role gives none.
    """
    rows = _in_scope(labels.where(F.col("label_type") == label_type), sessions, filters or [])
    rows = rows.join(F.broadcast(ranked.select(F.col("canonical_name").alias("canonical_label"))), "canonical_label", "left_semi")  # top-k names
    first = rows.groupBy("source_session_id").agg(F.min(F.struct("source_node_id", "source_turn_ids")).alias("f"))
    each = first.select(F.col("source_session_id").alias("session_id"), F.col("f.source_node_id").alias("source_event_id"), F.explode("f.source_turn_ids").alias("turn_id"))
    allowed = each.join(turns.where(F.lower("speaker") == role).select("session_id", "turn_id"), ["session_id", "turn_id"], "left_semi")
    refs = allowed.groupBy("session_id", "source_event_id").agg(F.array_sort(F.collect_set("turn_id")).alias("turn_ids"))
    return refs.join(sessions.select("session_id", "subject_path"), "session_id").select("source_event_id", "session_id", "subject_path", "turn_ids")


def pair_representatives(labels: DataFrame, top: DataFrame) -> DataFrame:
    """For each ranked pair the first session that has both, and its least misconception node."""
    m = labels.where("label_type = 'MISCONCEPTION'").groupBy("source_session_id", F.col("canonical_label").alias("misconception")).agg(F.min("source_node_id").alias("source_event_id"))
    t = labels.where("label_type = 'TUTOR_STRATEGY'").select("source_session_id", F.col("canonical_label").alias("strategy")).distinct()
    both = m.join(t, "source_session_id").join(F.broadcast(top.select("misconception", "strategy")), ["misconception", "strategy"], "left_semi")  # top-k pairs
    return both.groupBy("misconception", "strategy").agg(F.min(F.struct("source_session_id", "source_event_id")).alias("f")).select("misconception", "strategy", F.col("f.source_session_id").alias("session_id"), F.col("f.source_event_id").alias("source_event_id"))


def subject_statistics(cards: DataFrame) -> DataFrame:
    """Per subject: cards, distinct sessions and names; most cards first, ties by subject."""
    return cards.groupBy("subject_path").agg(F.count("*").alias("total"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("misconception_name").alias("names"))


@dataclass
class Result:
    """What an operation answers: rows, scope, references and status."""

    operation: str
    rows: list[dict]
    total_sessions: int
    matched_sessions: int
    filters: list[str]
    status: str
    reason: str | None = None
    refs: list[dict] = field(default_factory=list)
    unmeasured: tuple[str, ...] = UNMEASURED


def run(operation: str, labels: DataFrame, sessions: DataFrame, turns: DataFrame, top_k: int = 3, filters: list[str] | None = None) -> Result:
    """An operation by name, with its status: NO_MATCHING_SCOPE, NO_EVIDENCE or MEASURED. Results are top-k reports."""
    filters = filters or []
    total, matched = scope_counts(sessions, filters).first()
    none = lambda status, reason: Result(operation, [], total, matched, filters, status, reason)
    if not matched:
        return none("NO_MATCHING_SCOPE", "no session matches the filters") if filters else none("NO_EVIDENCE", "there are no sessions")
    if operation == "misconception_strategy_pairs":
        top = pairs(labels, sessions, top_k, filters)
        refs = pair_representatives(labels, top)
    elif operation == "content_opportunities":
        top = content_opportunities(labels, sessions, top_k, filters)
        refs = representatives(labels, rank_labels(labels, sessions, "MISCONCEPTION", 1000, filters), sessions, turns, "MISCONCEPTION", "student", filters)
    else:
        kind, role = OPERATIONS[operation]
        top = rank_labels(labels, sessions, kind, top_k, filters)
        refs = representatives(labels, top, sessions, turns, kind, role, filters)
    rows = [r.asDict() for r in top.collect()]
    if not rows:
        return none("NO_EVIDENCE", "sessions match but nothing is labelled so")
    # a report: as many references as rows asked for, the smallest sessions first
    few = [r.asDict() for r in refs.orderBy("session_id").limit(max(top_k, 1)).collect()]
    return Result(operation, rows, total, matched, filters, "MEASURED", None, few)
