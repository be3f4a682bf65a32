"""The session graph: nodes, edges and label assignments as tables, their checks and fingerprint.

Each node or edge type is one select; they are put together by name. Turn lists are sorted arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.taxonomy import Taxonomy

VERSION = "session-card-graph-v1"
NODE = ("node_id", "node_type", "label", "source_session_id", "source_card_id", "source_turn_ids")
EDGE = ("edge_id", "source_node_id", "target_node_id", "edge_type", "source_session_id", "source_turn_ids")
LABEL = ("assignment_id", "source_node_id", "label_type", "canonical_label", "taxonomy_version", "source_session_id", "source_turn_ids")


def _node(df: DataFrame, kind: str, node: Column, label: Column, turns: str = "all_turns", card: Column | None = None) -> DataFrame:
    return df.select(node.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"), F.col("session_id").alias("source_session_id"), (card if card is not None else F.lit(None).cast("string")).alias("source_card_id"), F.col(turns).alias("source_turn_ids"))


def _edge(df: DataFrame, kind: str, source: Column, target: Column, turns: Column) -> DataFrame:
    return df.select(tx.edge_id(F.lit(kind), source, target).alias("edge_id"), source.alias("source_node_id"), target.alias("target_node_id"), F.lit(kind).alias("edge_type"), F.col("session_id").alias("source_session_id"), turns.alias("source_turn_ids"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Projection:
    """Graph tables of sessions with one misconception card (mc) and one strategy card (st) each."""

    def __init__(self, sessions: DataFrame, mc: DataFrame, st: DataFrame, turns: DataFrame, taxonomy: Taxonomy | None = None) -> None:
        t = self.taxonomy = taxonomy or Taxonomy()
        self.turns = turns
        ids = turns.groupBy("session_id").agg(F.array_sort(F.collect_list("turn_id")).alias("all_turns"), F.lower(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("turn_id", "text"))), lambda x: x["text"]))).alias("session_text"))
        m = mc.select("session_id", F.col("chunk_id").alias("mc_id"), F.col("misconception_name").alias("mc_name"), "deep_mechanism", F.array_sort("source_turn_ids").alias("mc_turns"))
        s = st.select("session_id", F.col("chunk_id").alias("st_id"), F.col("strategy_category").alias("st_name"), "key_aha_question", F.coalesce("talk_moves", F.array().cast("array<string>")).alias("moves"), F.array_sort("source_turn_ids").alias("st_turns"))
        # all of a session's parts in one row: every node and edge below is a projection of it
        rows = sessions.join(ids, "session_id").join(m, "session_id").join(s, "session_id")
        mc_text = tx.flat_text(F.col("mc_name"), F.col("deep_mechanism"))
        st_text = tx.flat_text(F.col("st_name"), F.col("moves"), F.col("key_aha_question"))
        self.rows = rows.withColumns({
            "subject": tx.subject_key(F.col("subject_path")),
            "move_keys": F.array_sort(F.array_distinct(F.transform("moves", tx.talk_move_key))),
            "mc_label": t.first("MISCONCEPTION", mc_text),
            "exam_label": t.first("EXAM_ERROR", mc_text),
            "content_label": t.content_opportunity(mc_text, F.col("deep_mechanism").isNotNull() & (F.col("deep_mechanism") != "")),
            "st_labels": t.every("TUTOR_STRATEGY", st_text),
            "difficulty": t.every("DIFFICULTY_SIGNAL", F.col("session_text")),
        })
        self.session, self.question, self.subject_node = tx.node_id("session", F.col("session_id")), tx.node_id("question", F.col("question_id")), tx.node_id("subject", F.col("subject"))
        self.mc, self.st = tx.node_id("misconception-event", F.col("mc_id")), tx.node_id("tutor-strategy-event", F.col("st_id"))

    def nodes(self) -> DataFrame:
        r = self.rows
        labels, moves = r.withColumn("x", F.explode("st_labels")), r.withColumn("x", F.explode("move_keys"))
        each = self.turns.join(r.select("session_id"), "session_id", "left_semi").withColumn("one", F.array("turn_id"))
        text = lambda p, c: F.concat_ws(" ", F.lit(p), c.cast("string"))
        return _union([
            _node(r, "SESSION", self.session, text("session", F.col("session_id"))),
            _node(r, "QUESTION", self.question, text("question", F.col("question_id"))),
            _node(r, "SUBJECT", self.subject_node, F.col("subject")),
            _node(r, "MISCONCEPTION_EVENT", self.mc, F.coalesce("mc_name", "mc_id"), "mc_turns", F.col("mc_id")),
            _node(r, "TUTOR_STRATEGY_EVENT", self.st, F.coalesce("st_name", "st_id"), "st_turns", F.col("st_id")),
            _node(r, "MISCONCEPTION_CONCEPT", tx.node_id("misconception-concept", F.col("mc_label")), F.col("mc_label"), "mc_turns"),
            _node(labels, "STRATEGY_CONCEPT", tx.node_id("strategy-concept", F.col("x")), F.col("x"), "st_turns"),
            _node(each, "TURN", tx.node_id("turn", F.col("session_id"), F.col("turn_id")), text("turn", F.col("turn_id")), "one"),
            _node(moves, "TALK_MOVE", tx.node_id("talk-move", F.col("x")), F.col("x")),
        ])

    def edges(self) -> DataFrame:
        r, mc, st = self.rows, self.mc, self.st
        every = F.col("all_turns")
        turn = tx.node_id("turn", F.col("session_id"), F.col("x"))
        over = lambda c: r.withColumn("x", F.explode(c))
        labels, moves, one = over("st_labels"), over("move_keys"), F.array("x")
        return _union([
            _edge(r, "ANCHORS", self.session, self.question, every),
            _edge(r, "ABOUT_SUBJECT", self.session, self.subject_node, every),
            _edge(r, "HAS_MISCONCEPTION", self.session, mc, F.col("mc_turns")),
            _edge(r, "HAS_STRATEGY", self.session, st, F.col("st_turns")),
            _edge(r, "TYPE_OF", mc, tx.node_id("misconception-concept", F.col("mc_label")), F.col("mc_turns")),
            _edge(labels, "TYPE_OF", st, tx.node_id("strategy-concept", F.col("x")), F.col("st_turns")),
            _edge(r, "CO_OCCURS_WITH", mc, st, F.array_sort(F.array_union("mc_turns", "st_turns"))),
            _edge(over("mc_turns"), "EVIDENCED_BY", mc, turn, one),
            _edge(over("st_turns"), "EVIDENCED_BY", st, turn, one),
            _edge(over("all_turns"), "HAS_TURN", self.session, turn, one),
            _edge(moves, "USES_TALK_MOVE", st, tx.node_id("talk-move", F.col("x")), F.col("st_turns")),
        ])

    def assignments(self) -> DataFrame:
        r, t = self.rows, self.taxonomy
        asked = self.turns.where((F.col("speaker") == "student") & ~F.col("is_noise")).join(r.select("session_id"), "session_id", "left_semi")

        def of(df: DataFrame, kind: str, node: Column, label: Column, turns: Column) -> DataFrame:
            row = df.select(node.alias("source_node_id"), F.lit(kind).alias("label_type"), label.alias("canonical_label"), F.lit(t.version).alias("taxonomy_version"), F.col("session_id").alias("source_session_id"), turns.alias("source_turn_ids"))
            return row.withColumn("assignment_id", F.sha2(F.concat_ws("\x1f", "source_node_id", "label_type", "canonical_label"), 256))

        return _union([
            of(r, "MISCONCEPTION", self.mc, F.col("mc_label"), F.col("mc_turns")),
            of(r, "EXAM_ERROR", self.mc, F.col("exam_label"), F.col("mc_turns")),
            of(r, "CONTENT_OPPORTUNITY", self.mc, F.col("content_label"), F.col("mc_turns")),
            of(r.withColumn("x", F.explode("st_labels")), "TUTOR_STRATEGY", self.st, F.col("x"), F.col("st_turns")),
            of(r.withColumn("x", F.explode("difficulty")), "DIFFICULTY_SIGNAL", self.session, F.col("x"), F.col("all_turns")),
            of(asked, "QUESTION_FUNCTION", tx.node_id("turn", F.col("session_id"), F.col("turn_id")), t.question_function(F.lower("text")), F.array("turn_id")),
        ]).select(*LABEL)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row a node id: what its first session says, and how many sessions and which name it."""
    # min_by and a set of sessions merge before the shuffle; only the first row's fields move
    return nodes.groupBy("node_id", "node_type").agg(F.min_by("label", "source_session_id").alias("label"), F.min("source_session_id").alias("source_session_id"), F.count_distinct("source_session_id").alias("sessions"))


def illegal_duplicates(nodes: DataFrame) -> DataFrame:
    """Node ids that more than one session names though their type belongs to one."""
    shared = ("QUESTION", "SUBJECT", "TALK_MOVE", "MISCONCEPTION_CONCEPT", "STRATEGY_CONCEPT")
    return merge_nodes(nodes).where((F.col("sessions") > 1) & ~F.col("node_type").isin(*shared)).select("node_id", "node_type", "sessions")


def pointer_violations(cards: DataFrame, turns: DataFrame, role: str) -> DataFrame:
    """chunk_id, turn_id, reason of each card pointer that repeats, points nowhere or to the other role."""
    each = cards.select("chunk_id", "session_id", F.explode("source_turn_ids").alias("turn_id")).groupBy("chunk_id", "session_id", "turn_id").agg(F.count("*").alias("times"))
    seen = turns.select("session_id", "turn_id", "speaker")
    reason = F.when(F.col("times") > 1, "DUPLICATE").when(F.col("speaker").isNull(), "MISSING_TURN").when(F.col("speaker") != role, "WRONG_ROLE")
    return each.join(seen, ["session_id", "turn_id"], "left").withColumn("reason", reason).where("reason is not null").select("chunk_id", "turn_id", "reason")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leaves or enters."""
    return nodes.join(edges.select(F.col("source_node_id").alias("node_id")), "node_id", "left_anti").join(edges.select(F.col("target_node_id").alias("node_id")), "node_id", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edge_id and which end has no node."""
    known = nodes.select("node_id").distinct()
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.lit("source").alias("end"), F.col("source_node_id").alias("node_id")), F.struct(F.lit("target").alias("end"), F.col("target_node_id").alias("node_id")))).alias("e")).select("edge_id", "e.*")
    return ends.join(known, "node_id", "left_anti").select("edge_id", "end")


def evidence_pointers(edges: DataFrame, nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """edge_id, reason of each EVIDENCED_BY edge: VALID, or what is missing: event, turn node, turn, role."""
    e = edges.where("edge_type = 'EVIDENCED_BY'").select("edge_id", "source_node_id", "target_node_id", "source_session_id", F.element_at("source_turn_ids", 1).alias("turn_id"))
    kinds = nodes.groupBy("node_id").agg(F.min("node_type").alias("kind"))
    joined = e.join(kinds.select(F.col("node_id").alias("source_node_id"), F.col("kind").alias("source_kind")), "source_node_id", "left")
    joined = joined.join(kinds.select(F.col("node_id").alias("target_node_id"), F.col("kind").alias("target_kind")), "target_node_id", "left")
    joined = joined.join(turns.select(F.col("session_id").alias("source_session_id"), "turn_id", "speaker"), ["source_session_id", "turn_id"], "left")
    wanted = F.when(F.col("source_kind") == "MISCONCEPTION_EVENT", "student").when(F.col("source_kind") == "TUTOR_STRATEGY_EVENT", "tutor")
    reason = F.when(F.coalesce(wanted, F.lit("")) == "", "MISSING_EVENT").when(F.coalesce(F.col("target_kind"), F.lit("")) != "TURN", "MISSING_TURN_NODE").when(F.col("speaker").isNull(), "MISSING_TURN").when(F.col("speaker") != wanted, "WRONG_ROLE").otherwise("VALID")
    return joined.select("edge_id", reason.alias("reason"))


def session_paths(edges: DataFrame, nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """source type, edge type, target type and how many edges, for the given sessions' edges."""
    kinds = nodes.groupBy("node_id").agg(F.min("node_type").alias("kind"))
    e = edges.join(sessions.select(F.col("session_id").alias("source_session_id")).distinct(), "source_session_id", "left_semi")
    e = e.join(kinds.select(F.col("node_id").alias("source_node_id"), F.col("kind").alias("source_type")), "source_node_id").join(kinds.select(F.col("node_id").alias("target_node_id"), F.col("kind").alias("target_type")), "target_node_id")
    return e.groupBy("source_type", "edge_type", "target_type").agg(F.count("*").alias("n"))


def type_counts(rows: DataFrame, kind: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.count("*").alias("n"))


def taxonomy_coverage(assignments: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Per label type: classified, unclassified and invalid assignments."""
    allowed = (taxonomy or Taxonomy()).labels
    valid = F.lit(False)
    for kind, labels in allowed.items():
        valid = valid | ((F.col("label_type") == kind) & F.col("canonical_label").isin(*labels))
    bare = F.col("canonical_label") == "UNCLASSIFIED"
    return assignments.groupBy("label_type").agg(F.count("*").alias("total"), F.count_if(valid & ~bare).alias("classified"), F.count_if(bare).alias("unclassified"), F.count_if(~valid & ~bare).alias("invalid"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n and a hash that row order doesn't change: a sum of row hashes, so nothing is sorted or gathered."""
    cells = [F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if dict(rows.dtypes)[c].startswith("array") else F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    half = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(half), F.lit(0)).cast("string").alias("fingerprint"))


def verify_evidence(refs: DataFrame, events: DataFrame, turns: DataFrame, role: str, most_sessions: int = 5) -> DataFrame:
    """Evidence rows of authorised references: evidence_id, session_id, turn_id, speaker, text.

    refs: source_event_id, session_id, turn_ids. A reference counts only if its event is there, belongs to its
    session and has its turns; turns of the other role and repeated turns go; the first sessions are kept.
    """
    own = events.select(F.col("node_id").alias("source_event_id"), F.col("source_session_id").alias("session_id"), F.col("source_turn_ids").alias("held"))
    ok = refs.join(own, ["source_event_id", "session_id"]).where(F.size(F.array_except("turn_ids", "held")) == 0)
    # the first sessions are a report of a few rows: the limit is the feature
    first = ok.select("session_id").distinct().orderBy("session_id").limit(most_sessions)
    rows = ok.join(F.broadcast(first), "session_id").select("session_id", F.explode("turn_ids").alias("turn_id")).distinct().join(turns, ["session_id", "turn_id"]).where(F.col("speaker") == role)
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy("session_id", "turn_id"))
    return rows.select(F.format_string("E%03d", nth).alias("evidence_id"), "session_id", "turn_id", "speaker", "text")
