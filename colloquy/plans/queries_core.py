"""Queries for sources, ETL, filters, joins, aggregations, windows, graph and macro analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics, etl, evidence, graph, windows
from . import surrogates as sg
from .surrogates import CARDS, GRAPH, S, T, table, windows_sql

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def joined(c: str):
    """An array column as comma-joined text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def _labels(spark, d):
    return sg.projection(spark, d).assignments()


# ETL

RUNS = """r AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS c FROM events),
u AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS INTEGER) AS turn_id FROM r)"""


@query("a5_turn_runs", f"WITH {RUNS} SELECT user_id, turn_id, event_type, count(*) AS n, min(event_id) AS least_event FROM u GROUP BY user_id, turn_id, event_type")
def a5(spark, d):
    rows = etl.turn_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "turn_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("least_event"))


@query("w2_speaker_changes", f"WITH {RUNS} SELECT user_id, CAST(max(turn_id) - 1 AS BIGINT) AS changes FROM u GROUP BY user_id")
def w2(spark, d):
    rows = etl.turn_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id").agg((F.max("turn_id") - 1).cast("long").alias("changes"))


@query("a6_distinct_moves", """WITH f AS (SELECT user_id, event_type, min(ts) AS ts, min_by(event_id, (ts, event_id)) AS e FROM events GROUP BY user_id, event_type)
SELECT user_id, string_agg(event_type, ',' ORDER BY ts, e) AS moves FROM f GROUP BY user_id""")
def a6(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("moves"))


@query("a7_turn_counts", f"""WITH {T}, {S} SELECT session_id, total_turns, student_turn_count, tutor_turn_count,
total_turns >= 2 AND student_turn_count > 0 AND tutor_turn_count > 0 AS has_valid_tutoring FROM s""")
def a7(spark, d):
    return etl.session_counts(sg.turns(spark, d))


@query("p9_quality_gate", f"WITH {T}, {S} SELECT session_id FROM s WHERE total_turns >= 2 AND student_turn_count > 0 AND tutor_turn_count > 0")
def p9(spark, d):
    return etl.session_counts(sg.turns(spark, d)).where("has_valid_tutoring").select("session_id")


EAV = f"""{T}, m AS (SELECT session_id AS q, turn_id AS seq, trim(text) AS x, CASE WHEN speaker = 'student' THEN 'Question Text' ELSE 'Answer ' || chr(65 + turn_id % 4) || ' Text' END AS label FROM t)"""


def _eav(spark, d):
    label = F.when(F.col("speaker") == "student", "Question Text").otherwise(F.concat(F.lit("Answer "), F.char(65 + F.col("turn_id") % 4), F.lit(" Text")))
    return sg.turns(spark, d).select(F.col("session_id").alias("QuestionId_DQ"), F.col("text").alias("Text"), F.col("turn_id").alias("Sequence"), label.alias("Label"))


_OPTIONS = ", ".join(f"max_by(x, seq) FILTER (WHERE label = 'Answer {k} Text') AS option_{k.lower()}" for k in "ABCD")


@query("a8_question_pivot", f"WITH {EAV} SELECT q AS question_id, coalesce(string_agg(x, chr(10) ORDER BY seq) FILTER (WHERE label = 'Question Text' AND x <> ''), '') AS question_text, {_OPTIONS} FROM m GROUP BY q")
def a8(spark, d):
    p = etl.pivot_questions(_eav(spark, d))
    return p.select("question_id", "question_text", *[F.try_element_at("options", F.lit(k)).alias(f"option_{k.lower()}") for k in "ABCD"])


def _subjects(spark, d):
    n, r, s = (table(spark, d, x) for x in ("nation", "region", "supplier"))
    base = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    level = lambda i, id_, parent, name: base.select(F.col("s_suppkey").alias("InterventionId"), id_.cast("long").alias("SubjectId"), parent.cast("long").alias("ParentSubjectId"), name.alias("SubjectName"), F.lit(i).alias("SubjectLevel"))
    return level(1, F.col("r_regionkey") + 1, F.lit(None), F.col("r_name")).unionByName(level(2, F.col("n_nationkey") + 100, F.col("r_regionkey") + 1, F.col("n_name"))).unionByName(level(3, F.col("s_suppkey") + 1000, F.col("n_nationkey") + 100, F.col("s_name")))


@query("a9_subject_paths", """SELECT s_suppkey AS intervention_id, trim(r_name) || ' > ' || trim(n_name) || ' > ' || trim(s_name) AS paths, trim(r_name) AS subjects, trim(n_name) AS topics, trim(s_name) AS subtopics
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def a9(spark, d):
    return etl.subject_paths(_subjects(spark, d)).select(F.col("InterventionId").alias("intervention_id"), *[F.array_join(c, " | ").alias(c) for c in ("paths", "subjects", "topics", "subtopics")])


@query("j1_session_fusion", f"""WITH {EAV}, {S}, o AS (SELECT q, string_agg(x, chr(10) ORDER BY seq) FILTER (WHERE label = 'Question Text' AND x <> '') AS stem FROM m GROUP BY q)
SELECT s.session_id, s.subject_path, s.total_turns, coalesce(o.stem, '') AS question_text FROM s LEFT JOIN o ON o.q = s.session_id""")
def j1(spark, d):
    s, q = sg.sessions(spark, d).select("session_id", "subject_path", "total_turns"), etl.pivot_questions(_eav(spark, d)).select(F.col("question_id").alias("session_id"), "question_text")
    return s.join(q, "session_id", "left").withColumn("question_text", F.coalesce("question_text", F.lit("")))


@query("a10_dataset_statistics", f"""WITH {T}, {S} SELECT count(*) AS n, CAST(sum(total_turns) AS BIGINT) AS total, round(avg(total_turns), 6) AS mean, quantile_cont(total_turns, 0.25) AS p25,
quantile_cont(total_turns, 0.5) AS median, quantile_cont(total_turns, 0.75) AS p75, min(total_turns) AS least, max(total_turns) AS most FROM s""")
def a10(spark, d):
    return etl.dataset_statistics(sg.sessions(spark, d), "total_turns").withColumn("mean", F.round("mean", 6))


@query("a10_top_values", "SELECT props, count(*) AS n FROM events GROUP BY props ORDER BY n DESC, props LIMIT 10")
def a10b(spark, d):
    return etl.top_values(table(spark, d, "events"), "props", 10)


@query("a12_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("conversations", "documents", "embeddings", "labels", "pages")))
def a12(spark, d):
    out = None
    for t in ("conversations", "documents", "embeddings", "labels", "pages"):
        one = table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s6_upsert", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, CASE WHEN value > 50 THEN upper(event_type) ELSE event_type END AS event_type FROM events) GROUP BY event_type")
def s6(spark, d):
    from ..sources.tables import upsert

    e = table(spark, d, "events").select("event_id", "event_type", "value")
    new = e.where("value > 50").withColumn("event_type", F.upper("event_type"))
    return upsert(e, new, ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# filters

@query("p1_scope_all", f"WITH {T}, {S} SELECT session_id FROM s WHERE subject_path LIKE '%Number%' AND subject_path LIKE '%ound%'")
def p1(spark, d):
    return analytics.scoped(sg.sessions(spark, d), ["Number", "ound"])


@query("p2_scope_any", f"{CARDS} SELECT chunk_id FROM mc WHERE contains(subject_path, 'Algebra') OR contains(subject_path, 'Rounding')")
def p2(spark, d):
    return sg.misconceptions(spark, d).where(analytics.contains_any("subject_path", ["Algebra", "Rounding"])).select("chunk_id")


@query("p3_misconception_lookup", f"{CARDS} SELECT session_id, misconception_name FROM mc WHERE contains(subject_path, 'Number') AND (contains(misconception_name, 'the') OR contains(deep_mechanism, 'the'))")
def p3(spark, d):
    c = sg.misconceptions(spark, d)
    return c.where(F.contains("subject_path", F.lit("Number")) & (F.contains("misconception_name", F.lit("the")) | F.contains("deep_mechanism", F.lit("the")))).orderBy("session_id").select("session_id", "misconception_name")


@query("p4_strategy_lookup", f"{CARDS} SELECT session_id, key_aha_question FROM st WHERE strategy_category = 'Modelling' AND contains(subject_path, 'Number')")
def p4(spark, d):
    return sg.strategies(spark, d).where((F.col("strategy_category") == "Modelling") & F.contains("subject_path", F.lit("Number"))).select("session_id", "key_aha_question")


@query("p5_student_questions", f"WITH {T} SELECT session_id, turn_id, text FROM t WHERE speaker = 'student' AND NOT is_noise AND (contains(lower(text), 'whth') OR contains(lower(text), 'ndre')) ORDER BY session_id, turn_id LIMIT 50")
def p5(spark, d):
    t = sg.turns(spark, d)
    hit = tx.any_of([F.contains(F.lower("text"), F.lit(w)) for w in ("whth", "ndre")])
    return t.where((F.col("speaker") == "student") & ~F.col("is_noise") & hit).orderBy("session_id", "turn_id").limit(50).select("session_id", "turn_id", "text")


@query("p6_turn_lookup", f"WITH {T} SELECT session_id, turn_id, speaker, text FROM t WHERE turn_id IN (1, 2, 4)")
def p6(spark, d):
    asked = sg.sessions(spark, d).select("session_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 4)])).alias("turn_id"))  # the turns that are looked up
    return sg.turns(spark, d).join(asked, ["session_id", "turn_id"]).select("session_id", "turn_id", "speaker", "text")


@query("p7_metadata_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id IS DISTINCT FROM 3 AND props IS NOT NULL")
def p7(spark, d):
    from ..operators.retrieval import metadata_matches

    e = table(spark, d, "events")
    where = {"event_type": {"$in": ["click", "view"]}, "user_id": {"$ne": 3}, "missing": None}
    return e.where(metadata_matches({"event_type": F.col("event_type"), "user_id": F.col("user_id")}, where) & F.col("props").isNotNull()).select("event_id")


@query("p8_authorized_sessions", f"WITH {T}, {S} SELECT t.session_id, count(*) AS n FROM t WHERE t.session_id IN (SELECT session_id FROM s WHERE subject_path LIKE 'Algebra%') GROUP BY t.session_id")
def p8(spark, d):
    allowed = sg.sessions(spark, d).where("subject_path like 'Algebra%'").select("session_id")
    return sg.turns(spark, d).join(allowed, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n"))


@query("p12_role_turns", f"{CARDS} SELECT t.session_id, t.turn_id, t.text FROM t JOIN (SELECT session_id, unnest(source_turn_ids) AS turn_id FROM mc) p USING (session_id, turn_id) WHERE speaker = 'student'")
def p12(spark, d):
    p = sg.misconceptions(spark, d).select("session_id", F.explode("source_turn_ids").alias("turn_id"))
    return sg.turns(spark, d).where("speaker = 'student'").join(p, ["session_id", "turn_id"]).select("session_id", "turn_id", "text")


@query("p13_spoken_turns", f"WITH {T} SELECT session_id, turn_id FROM t WHERE speaker = 'tutor' AND NOT is_noise")
def p13(spark, d):
    return sg.turns(spark, d).where((F.col("speaker") == "tutor") & ~F.col("is_noise")).select("session_id", "turn_id")


@query("p14_meaningful_metadata", "SELECT count(*) AS n, count(*) FILTER (WHERE props IS NOT NULL AND trim(props) NOT IN ('', '{}', '[]', 'null')) AS meaningful FROM events")
def p14(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(evidence.meaningful("props")).alias("meaningful"))


@query("p15_scope_status", f"WITH {T}, {S} SELECT f AS filter, CASE WHEN count(*) FILTER (WHERE subject_path LIKE '%' || f || '%') = 0 THEN 'NO_MATCHING_SCOPE' ELSE 'MEASURED' END AS status FROM s, (VALUES ('Number'), ('Number'' OR 1=1 --')) v(f) GROUP BY f")
def p15(spark, d):
    p = sg.projection(spark, d)
    labels, s, t = p.assignments(), sg.sessions(spark, d), sg.turns(spark, d)
    rows = [(f, analytics.run("recurring_misconceptions", labels, s, t, 3, [f]).status) for f in ("Number", "Number' OR 1=1 --")]
    return spark.createDataFrame(rows, "filter string, status string")


# joins

@query("j2_cards_with_sessions", f"{CARDS} SELECT mc.chunk_id, s.question_text, s.total_turns FROM mc JOIN s USING (session_id)")
def j2(spark, d):
    return sg.misconceptions(spark, d).join(sg.sessions(spark, d).select("session_id", "question_text", "total_turns"), "session_id").select("chunk_id", "question_text", "total_turns")


@query("j3_evidence_trace", f"{CARDS} SELECT chunk_id, string_agg(t.turn_id || ':' || t.speaker || ':' || t.text, chr(10) ORDER BY t.turn_id) AS evidence FROM (SELECT chunk_id, session_id, unnest(source_turn_ids) AS turn_id FROM mc) p JOIN t USING (session_id, turn_id) GROUP BY chunk_id")
def j3(spark, d):
    from ..operators.retrieval import attach_evidence

    cards = sg.misconceptions(spark, d)
    out = attach_evidence(cards.select(F.col("chunk_id").alias("id")), cards, sg.turns(spark, d))
    return out.select(F.col("id").alias("chunk_id"), F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["turn_id"].cast("string"), e["speaker"], e["text"])), "\n").alias("evidence"))


_PAIRS = """FROM l m JOIN l t2 ON m.source_session_id = t2.source_session_id WHERE m.label_type = 'MISCONCEPTION' AND t2.label_type = 'TUTOR_STRATEGY'"""


@query("j4_pair_cooccurrence", f"{GRAPH} SELECT m.canonical_label AS misconception, t2.canonical_label AS strategy, count(*) AS event_count, count(DISTINCT m.source_session_id) AS distinct_session_count {_PAIRS} GROUP BY 1, 2")
def j4(spark, d):
    return analytics.pairs(_labels(spark, d), sg.sessions(spark, d), None).select("misconception", "strategy", "event_count", "distinct_session_count")


@query("a2_event_pairs", """SELECT a.event_type AS misconception, b.event_type AS strategy, count(*) AS event_count, count(DISTINCT a.user_id) AS distinct_session_count FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type IN ('error', 'view') AND b.event_type NOT IN ('error', 'view') GROUP BY 1, 2""")
def a2(spark, d):
    kind = F.when(F.col("event_type").isin("error", "view"), "MISCONCEPTION").otherwise("TUTOR_STRATEGY")
    e = table(spark, d, "events").select(F.col("user_id").alias("source_session_id"), F.col("event_type").alias("canonical_label"), kind.alias("label_type"))
    s = e.select(F.col("source_session_id").alias("session_id"), F.lit("").alias("subject_path")).distinct()
    return analytics.pairs(e, s, None).select("misconception", "strategy", "event_count", "distinct_session_count")


@query("j5_pair_representatives", f"""{GRAPH}, x AS (SELECT m.canonical_label AS misconception, t2.canonical_label AS strategy, m.source_session_id AS session_id, m.source_node_id AS source_event_id,
row_number() OVER (PARTITION BY m.canonical_label, t2.canonical_label ORDER BY m.source_session_id, m.source_node_id) AS k {_PAIRS}) SELECT misconception, strategy, session_id, source_event_id FROM x WHERE k = 1""")
def j5(spark, d):
    labels = _labels(spark, d)
    return analytics.pair_representatives(labels, analytics.pairs(labels, sg.sessions(spark, d), None))


@query("j6_orphan_nodes", "SELECT c_custkey AS node_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j6(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"))
    edges = table(spark, d, "orders").where("o_totalprice > 300000").select((-F.col("o_orderkey") - 1).alias("source_node_id"), F.col("o_custkey").alias("target_node_id"))
    return graph.orphans(nodes, edges)


@query("j7_dangling_edges", "SELECT CAST(o_orderkey AS VARCHAR) AS edge_id, 'target' AS \"end\" FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def j7(spark, d):
    customers = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("node_id"))
    orders = table(spark, d, "orders")
    nodes = customers.unionByName(orders.select((-F.col("o_orderkey") - 1).alias("node_id")))
    return graph.dangling(orders.select(F.col("o_orderkey").cast("string").alias("edge_id"), (-F.col("o_orderkey") - 1).alias("source_node_id"), F.col("o_custkey").alias("target_node_id")), nodes)


@query("j8_evidence_pointers", f"""{GRAPH} SELECT CASE WHEN t.speaker IS NULL THEN 'MISSING_TURN' ELSE 'VALID' END AS reason, count(*) AS n FROM e
LEFT JOIN (SELECT * FROM t WHERE length(text) > 100) t ON t.session_id = e.session_id AND t.turn_id = e.ids[1] WHERE edge_type = 'EVIDENCED_BY' GROUP BY 1""")
def j8(spark, d):
    p = sg.projection(spark, d)
    return graph.evidence_pointers(p.edges(), p.nodes(), sg.turns(spark, d).where("length(text) > 100")).groupBy("reason").agg(F.count("*").alias("n"))


@query("j9_graph_paths", f"""{GRAPH}, k AS (SELECT node_id, min(node_type) AS kind FROM n GROUP BY node_id) SELECT k1.kind AS source_type, edge_type, k2.kind AS target_type, count(*) AS n
FROM e JOIN k k1 ON k1.node_id = a JOIN k k2 ON k2.node_id = b WHERE e.session_id IN (SELECT session_id FROM s WHERE subject_path LIKE 'Algebra%') GROUP BY 1, 2, 3""")
def j9(spark, d):
    p = sg.projection(spark, d)
    return graph.session_paths(p.edges(), p.nodes(), sg.sessions(spark, d).where("subject_path like 'Algebra%'"))


@query("j10_anchored_windows", f"""{CARDS}, {windows_sql(2, 1)}, p AS (SELECT session_id, chunk_id, unnest(source_turn_ids) AS turn_id FROM mc WHERE subject_path LIKE 'Number%'),
x AS (SELECT session_id, start, unnest(ids) AS turn_id FROM w) SELECT w.session_id, w.start, string_agg(DISTINCT p.chunk_id, ',') AS parent_ids, bool_or(s.subject_path LIKE 'Algebra%') AS completes
FROM w JOIN s ON s.session_id = w.session_id LEFT JOIN x ON x.session_id = w.session_id AND x.start = w.start LEFT JOIN p ON p.session_id = x.session_id AND p.turn_id = x.turn_id
GROUP BY w.session_id, w.start HAVING count(p.chunk_id) > 0 OR bool_or(s.subject_path LIKE 'Algebra%')""")
def j10(spark, d):
    w = windows.sliding_windows(sg.turns(spark, d), 2, 1)
    a = sg.misconceptions(spark, d).where("subject_path like 'Number%'").select("session_id", F.col("chunk_id").alias("parent_id"), "source_turn_ids")
    out = windows.anchored_windows(w, a, sg.sessions(spark, d).where("subject_path like 'Algebra%'"))
    ids = F.when(F.size("parent_ids") > 0, F.array_join("parent_ids", ","))
    return out.select("session_id", F.col("start").cast("long").alias("start"), ids.alias("parent_ids"), "completes")


@query("j11_id_parity", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def j11(spark, d):
    return evidence.id_parity(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("j12_batch_audit", f"{CARDS} SELECT 'misconception' AS kind, count(*) AS missing FROM s WHERE session_id NOT IN (SELECT session_id FROM mc) UNION ALL SELECT 'strategy', count(*) FROM s WHERE session_id NOT IN (SELECT session_id FROM st)")
def j12(spark, d):
    s = sg.sessions(spark, d)
    one = lambda cards, kind: evidence.id_parity(s, cards, "session_id").agg(F.lit(kind).alias("kind"), F.count_if(F.col("side") == "missing").alias("missing"))
    return one(sg.misconceptions(spark, d), "misconception").unionByName(one(sg.strategies(spark, d), "strategy"))


@query("j14_orphan_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j14(spark, d):
    return evidence.orphan_rows(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "doc_id")


# windows and chunks

@query("w4_sliding_windows", f"WITH {T}, {windows_sql(6, 3)} SELECT session_id, start, first_turn, last_turn, array_to_string(ids, ',') AS source_turn_ids, content FROM w")
def w4(spark, d):
    return windows.sliding_windows(sg.turns(spark, d)).select("session_id", F.col("start").cast("long").alias("start"), "first_turn", "last_turn", joined("source_turn_ids"), "content")


@query("w4_event_windows", """WITH t AS (SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn_id, event_type AS speaker, '' AS text FROM events), """
       + windows_sql(6, 3) + " SELECT session_id, start, first_turn, last_turn FROM w")
def w4b(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("turn_id"), F.col("event_type").alias("speaker"), F.lit("").alias("text"))
    return windows.sliding_windows(e).select("session_id", F.col("start").cast("long").alias("start"), "first_turn", "last_turn")


@query("w5_evidence_units", f"{CARDS}, {windows_sql(7, 3)} SELECT 'session_' || session_id || '_evidence_' || first_turn || '_' || last_turn AS chunk_id, array_to_string(ids, ',') AS source_turn_ids, mc.chunk_id AS card_ids FROM w JOIN mc USING (session_id)")
def w5(spark, d):
    return windows.evidence_units(sg.turns(spark, d), sg.misconceptions(spark, d)).select("chunk_id", joined("source_turn_ids"), "card_ids")


@query("w6_tail_windows", f"WITH {T}, {windows_sql(7, 3, False)} SELECT session_id, start, first_turn, last_turn FROM w")
def w6(spark, d):
    return windows.sliding_windows(sg.turns(spark, d), 7, 3, stop_at_end=False).select("session_id", F.col("start").cast("long").alias("start"), "first_turn", "last_turn")


@query("w9_run_shape", f"""WITH {T}, {S}, c AS (SELECT session_id, turn_id, turn_id - row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS i FROM t WHERE length(text) > 150),
r AS (SELECT session_id, min(turn_id) AS a, count(*) AS k FROM c GROUP BY session_id, i) SELECT session_id, max(k) AS longest, coalesce(max(k) FILTER (WHERE a = 1), 0) AS prefix,
coalesce(max(k) FILTER (WHERE a + k - 1 = total_turns), 0) AS suffix FROM r JOIN s USING (session_id) GROUP BY session_id""")
def w9(spark, d):
    covered = sg.turns(spark, d).where("length(text) > 150").select("session_id", "turn_id")
    return windows.run_shape(covered, sg.sessions(spark, d))


@query("a18_coverage", f"WITH {T}, {windows_sql(6, 3)} SELECT session_id, count(DISTINCT turn_id) AS covered FROM (SELECT session_id, unnest(ids) AS turn_id FROM w) GROUP BY session_id")
def a18(spark, d):
    return windows.coverage(windows.sliding_windows(sg.turns(spark, d))).groupBy("session_id").agg(F.count("*").alias("covered"))


@query("c2_window_chunks", f"""WITH {T}, {S}, {windows_sql(6, 3)}, x AS (SELECT w.*, question_id, subject_path, 'Subject: ' || subject_path || chr(10) || content AS body FROM w JOIN s USING (session_id))
SELECT 'session_' || session_id || '_win_' || first_turn || '_' || last_turn AS chunk_id, question_id, body AS content, CAST(floor(len(regexp_extract_all(body, '[a-zA-Z0-9]+')) * 1.3) AS BIGINT) AS token_count FROM x""")
def c2(spark, d):
    return windows.window_chunks(sg.turns(spark, d), sg.sessions(spark, d)).select("chunk_id", "question_id", "content", "token_count")


@query("c4_evidence_index", f"""WITH {T}, {windows_sql(6, 3)}, k AS (SELECT session_id, count(*) AS windows FROM w GROUP BY session_id)
SELECT t.session_id, coalesce(string_agg(turn_id, ',' ORDER BY turn_id) FILTER (WHERE speaker = 'student'), '') AS student_turns, coalesce(string_agg(turn_id, ',' ORDER BY turn_id) FILTER (WHERE speaker = 'tutor'), '') AS tutor_turns,
coalesce(string_agg(turn_id, ',' ORDER BY turn_id) FILTER (WHERE is_noise), '') AS noise_turns, sha256(string_agg(turn_id || chr(31) || speaker || chr(31) || text, chr(30) ORDER BY turn_id)) AS content_hash, any_value(windows) AS windows
FROM t JOIN k USING (session_id) GROUP BY t.session_id""")
def c4(spark, d):
    return windows.evidence_index(sg.turns(spark, d))


@query("c5_rebind_cards", f"""{CARDS}, o AS (SELECT session_id, list(turn_id ORDER BY turn_id) AS ids, min_by(text, turn_id) AS head, string_agg(text, chr(0) ORDER BY turn_id) AS every FROM t WHERE speaker = 'tutor' GROUP BY session_id)
SELECT chunk_id, CASE WHEN length(trim(regexp_replace(key_aha_question, '\\s+', ' ', 'g'))) > 0 THEN key_aha_question ELSE head END AS key_aha_question, array_to_string(ids, ',') AS source_turn_ids FROM st JOIN o USING (session_id)""")
def c5(spark, d):
    return windows.rebind_cards(sg.strategies(spark, d), sg.turns(spark, d), "tutor", "key_aha_question").select("chunk_id", "key_aha_question", joined("source_turn_ids"))


@query("c8_card_validation", f"""{CARDS} SELECT mc.chunk_id, CASE WHEN s2.session_id IS NULL THEN 'NO_SESSION' ELSE 'MISSING_TURN' END AS reason FROM mc LEFT JOIN (SELECT * FROM s WHERE subject_path <> 'Algebra/Equations') s2 ON s2.session_id = mc.session_id
WHERE s2.session_id IS NULL OR EXISTS (SELECT 1 FROM (SELECT unnest(mc.source_turn_ids) AS x) p WHERE p.x > 5)""")
def c8(spark, d):
    s = sg.sessions(spark, d).where("subject_path <> 'Algebra/Equations'")
    return evidence.validate_cards(sg.misconceptions(spark, d), sg.turns(spark, d).where("turn_id <= 5"), s, "student", "quote").where("reason in ('NO_SESSION', 'MISSING_TURN')")


@query("c10_batches", f"WITH {T}, {S} SELECT session_id, (row_number() OVER (ORDER BY session_id) - 1) // 100 AS batch FROM s")
def c10(spark, d):
    from ..sources.tables import batches

    return batches(sg.sessions(spark, d).select("session_id"), "session_id", 100)


# graph

@query("g1_nodes", f"{GRAPH} SELECT node_id, node_type, label, session_id AS source_session_id, card AS source_card_id, array_to_string(ids, ',') AS source_turn_ids FROM n")
def g1(spark, d):
    return sg.projection(spark, d).nodes().select("node_id", "node_type", "label", "source_session_id", "source_card_id", joined("source_turn_ids"))


@query("g2_edges", f"{GRAPH} SELECT edge_id, a AS source_node_id, b AS target_node_id, edge_type, session_id AS source_session_id, array_to_string(ids, ',') AS source_turn_ids FROM e")
def g2(spark, d):
    return sg.projection(spark, d).edges().select("edge_id", "source_node_id", "target_node_id", "edge_type", "source_session_id", joined("source_turn_ids"))


@query("g3_pointer_violations", f"{CARDS}, p AS (SELECT chunk_id, session_id, unnest(source_turn_ids) AS turn_id FROM st) SELECT chunk_id, p.turn_id, CASE WHEN t.speaker IS NULL THEN 'MISSING_TURN' ELSE 'WRONG_ROLE' END AS reason FROM p LEFT JOIN (SELECT * FROM t WHERE turn_id <= 5) t USING (session_id, turn_id) WHERE t.speaker IS DISTINCT FROM 'student'")
def g3(spark, d):
    return graph.pointer_violations(sg.strategies(spark, d), sg.turns(spark, d).where("turn_id <= 5"), "student")


_BY = "SELECT canonical_label, count(*) AS n, count(DISTINCT source_session_id) AS sessions FROM l WHERE label_type = '{}' GROUP BY canonical_label"


def _by(kind):
    return lambda spark, d: _labels(spark, d).where(F.col("label_type") == kind).groupBy("canonical_label").agg(F.count("*").alias("n"), F.count_distinct("source_session_id").alias("sessions"))


for _name, _kind in (("g4_misconception_labels", "MISCONCEPTION"), ("g4_exam_error_labels", "EXAM_ERROR"), ("g5_strategy_labels", "TUTOR_STRATEGY"), ("g6_question_functions", "QUESTION_FUNCTION"), ("g7_difficulty_signals", "DIFFICULTY_SIGNAL"), ("g8_content_opportunities", "CONTENT_OPPORTUNITY")):
    Q[_name], SQL[_name] = _by(_kind), f"{GRAPH} {_BY.format(_kind)}"


@query("d18_label_assignments", f"{GRAPH} SELECT assignment_id, source_node_id, label_type, canonical_label, source_session_id, array_to_string(source_turn_ids, ',') AS source_turn_ids FROM l")
def d18(spark, d):
    return _labels(spark, d).select("assignment_id", "source_node_id", "label_type", "canonical_label", "source_session_id", joined("source_turn_ids"))


@query("a14_merged_nodes", f"{GRAPH} SELECT node_id, node_type, min_by(label, session_id) AS label, min(session_id) AS source_session_id, count(DISTINCT session_id) AS sessions FROM n GROUP BY node_id, node_type")
def a14(spark, d):
    return graph.merge_nodes(sg.projection(spark, d).nodes())


@query("g9_illegal_duplicates", f"{GRAPH}, m AS (SELECT node_id, node_type, session_id FROM n UNION ALL SELECT node_id, node_type, session_id + 1000000 FROM n WHERE node_type IN ('TURN', 'SUBJECT') AND session_id % 3 = 0) SELECT node_id, node_type, count(DISTINCT session_id) AS sessions FROM m GROUP BY node_id, node_type HAVING count(DISTINCT session_id) > 1 AND node_type NOT IN ('QUESTION', 'SUBJECT', 'TALK_MOVE', 'MISCONCEPTION_CONCEPT', 'STRATEGY_CONCEPT')")
def g9(spark, d):
    nodes = sg.projection(spark, d).nodes()
    planted = nodes.where("node_type in ('TURN', 'SUBJECT') and source_session_id % 3 = 0").withColumn("source_session_id", F.col("source_session_id") + 1_000_000)
    return graph.illegal_duplicates(nodes.unionByName(planted))


@query("a13_edge_types", f"{GRAPH} SELECT edge_type, count(*) AS n FROM e GROUP BY edge_type")
def a13(spark, d):
    return graph.type_counts(sg.projection(spark, d).edges(), "edge_type")


@query("a13_node_types", f"{GRAPH} SELECT node_type, count(*) AS n FROM n GROUP BY node_type")
def a13b(spark, d):
    return graph.type_counts(sg.projection(spark, d).nodes(), "node_type")


@query("a15_taxonomy_coverage", f"{GRAPH} SELECT label_type, count(*) AS total, count(*) FILTER (WHERE canonical_label <> 'UNCLASSIFIED') AS classified, count(*) FILTER (WHERE canonical_label = 'UNCLASSIFIED') AS unclassified, CAST(0 AS BIGINT) AS invalid FROM l GROUP BY label_type")
def a15(spark, d):
    return graph.taxonomy_coverage(_labels(spark, d), sg.TAXONOMY)


@query("g10_evidence_bridge", f"""{GRAPH}, r AS (SELECT session_id, unnest(mc_turns) AS turn_id FROM g WHERE mc_label = 'ROUNDING_RULE_CONFUSION' AND session_id IN (SELECT session_id FROM g WHERE mc_label = 'ROUNDING_RULE_CONFUSION' ORDER BY session_id LIMIT 5))
SELECT printf('E%03d', row_number() OVER (ORDER BY session_id, turn_id)) AS evidence_id, session_id, turn_id, speaker, text FROM r JOIN t USING (session_id, turn_id)""")
def g10(spark, d):
    p = sg.projection(spark, d)
    refs = p.assignments().where("label_type = 'MISCONCEPTION' and canonical_label = 'ROUNDING_RULE_CONFUSION'").select(F.col("source_node_id").alias("source_event_id"), F.col("source_session_id").alias("session_id"), F.col("source_turn_ids").alias("turn_ids"))
    return graph.verify_evidence(refs, p.nodes().where("node_type = 'MISCONCEPTION_EVENT'"), sg.turns(spark, d).select("session_id", "turn_id", "speaker", "text"), "student")


@query("g11_fingerprint", f"""{GRAPH} SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(edge_id || chr(31) || a || chr(31) || b || chr(31) || edge_type), 1, 12)) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM e""")
def g11(spark, d):
    return graph.fingerprint(sg.projection(spark, d).edges(), ["edge_id", "source_node_id", "target_node_id", "edge_type"])


# macro analytics

def _macro_sql(kind: str, scope: str = "", k: int = 3) -> str:
    return f"""{GRAPH}, c AS (SELECT session_id FROM s {scope}), x AS (SELECT canonical_label AS canonical_name, count(*) AS event_count, count(DISTINCT source_session_id) AS distinct_session_count
FROM l WHERE label_type = '{kind}' AND source_session_id IN (SELECT session_id FROM c) GROUP BY canonical_label)
SELECT CAST(row_number() OVER (ORDER BY distinct_session_count DESC, event_count DESC, canonical_name) AS INTEGER) AS rank, canonical_name, event_count, distinct_session_count,
round(distinct_session_count / (SELECT count(*) FROM c), 9) AS session_share FROM x ORDER BY distinct_session_count DESC, event_count DESC, canonical_name LIMIT {k}"""


def _macro(kind, filters=None, k=3):
    return lambda spark, d: analytics.rank_labels(_labels(spark, d), sg.sessions(spark, d), kind, k, filters).withColumn("session_share", F.round("session_share", 9))


for _name, _op in (("m1_frequent_questions", "frequent_student_questions"), ("m2_difficult_concepts", "difficult_concepts"), ("m3_recurring_misconceptions", "recurring_misconceptions"), ("m4_exam_errors", "exam_error_patterns"), ("m5_tutor_strategies", "tutor_strategy_patterns")):
    _kind = analytics.OPERATIONS[_op][0]
    Q[_name], SQL[_name] = _macro(_kind), _macro_sql(_kind)
Q["m3_scoped_misconceptions"], SQL["m3_scoped_misconceptions"] = _macro("MISCONCEPTION", ["Number"], 5), _macro_sql("MISCONCEPTION", "WHERE subject_path LIKE '%Number%'", 5)


@query("a1_label_ranking", """WITH x AS (SELECT event_type AS canonical_name, count(*) AS event_count, count(DISTINCT user_id) AS distinct_session_count FROM events GROUP BY event_type)
SELECT CAST(row_number() OVER (ORDER BY distinct_session_count DESC, event_count DESC, canonical_name) AS INTEGER) AS rank, *, round(distinct_session_count / (SELECT count(DISTINCT user_id) FROM events), 9) AS session_share
FROM x ORDER BY distinct_session_count DESC, event_count DESC, canonical_name LIMIT 3""")
def a1(spark, d):
    e = table(spark, d, "events")
    labels = e.select(F.lit("EVENT").alias("label_type"), F.col("event_type").alias("canonical_label"), F.col("user_id").alias("source_session_id"))
    s = e.select(F.col("user_id").alias("session_id"), F.lit("").alias("subject_path")).distinct()
    return analytics.rank_labels(labels, s, "EVENT").withColumn("session_share", F.round("session_share", 9))


@query("a4_scope_counts", f"WITH {T}, {S} SELECT count(*) AS total_sessions, count(*) FILTER (WHERE subject_path LIKE '%Number%') AS matched_sessions FROM s")
def a4(spark, d):
    return analytics.scope_counts(sg.sessions(spark, d), ["Number"])


@query("a3_subject_statistics", f"{CARDS} SELECT subject_path, count(*) AS total, count(DISTINCT session_id) AS sessions, count(DISTINCT misconception_name) AS names FROM mc GROUP BY subject_path")
def a3(spark, d):
    return analytics.subject_statistics(sg.misconceptions(spark, d))


@query("m6_strategy_pairs", f"""{GRAPH}, x AS (SELECT m.canonical_label AS misconception, t2.canonical_label AS strategy, count(*) AS event_count, count(DISTINCT m.source_session_id) AS distinct_session_count {_PAIRS} GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY distinct_session_count DESC, event_count DESC, misconception, strategy) AS INTEGER) AS rank, misconception, strategy, 'CO_OCCURS_WITH' AS relation, event_count, distinct_session_count,
round(distinct_session_count / (SELECT count(*) FROM s), 9) AS session_share FROM x ORDER BY distinct_session_count DESC, event_count DESC, misconception, strategy LIMIT 3""")
def m6(spark, d):
    return analytics.pairs(_labels(spark, d), sg.sessions(spark, d)).withColumn("session_share", F.round("session_share", 9))


@query("m7_content_opportunities", f"""{GRAPH}, x AS (SELECT canonical_label AS canonical_name, count(*) AS event_count, count(DISTINCT source_session_id) AS distinct_session_count, count(DISTINCT source_session_id) / (SELECT count(*) FROM s) AS share,
CAST(bool_or(source_session_id IN (SELECT source_session_id FROM l WHERE label_type = 'CONTENT_OPPORTUNITY')) AS INTEGER) AS missing_content_flag FROM l WHERE label_type = 'MISCONCEPTION' GROUP BY canonical_label),
y AS (SELECT *, event_count * (1 - share) + missing_content_flag AS p FROM x)
SELECT CAST(row_number() OVER (ORDER BY p DESC, canonical_name) AS INTEGER) AS rank, canonical_name, event_count, distinct_session_count, round(share, 9) AS session_share, missing_content_flag, event_count AS repeated_error_count, round(p, 6) AS priority_score
FROM y ORDER BY p DESC, canonical_name LIMIT 3""")
def m7(spark, d):
    out = analytics.content_opportunities(_labels(spark, d), sg.sessions(spark, d))
    return out.withColumns({"session_share": F.round("session_share", 9), "priority_score": F.round("priority_score", 6)})


@query("m8_representatives", f"""{GRAPH}, top AS (SELECT canonical_label FROM l WHERE label_type = 'MISCONCEPTION' GROUP BY 1 ORDER BY count(DISTINCT source_session_id) DESC, count(*) DESC, canonical_label LIMIT 3)
SELECT source_node_id AS source_event_id, source_session_id AS session_id, s.subject_path, array_to_string(source_turn_ids, ',') AS turn_ids FROM l JOIN s ON s.session_id = source_session_id WHERE label_type = 'MISCONCEPTION' AND canonical_label IN (SELECT canonical_label FROM top)""")
def m8(spark, d):
    labels, s = _labels(spark, d), sg.sessions(spark, d)
    top = analytics.rank_labels(labels, s, "MISCONCEPTION")
    return analytics.representatives(labels, top, s, sg.turns(spark, d), "MISCONCEPTION", "student").select("source_event_id", "session_id", "subject_path", joined("turn_ids"))


@query("m9_data_scope", f"WITH {T}, {S} SELECT count(*) AS total_sessions, count(*) FILTER (WHERE subject_path LIKE '%Algebra%') AS matched_sessions, 'MEASURED' AS status, 'UNRESOLVED_ENDING' AS unmeasured FROM s")
def m9(spark, d):
    r = analytics.run("tutor_strategy_patterns", _labels(spark, d), sg.sessions(spark, d), sg.turns(spark, d), 3, ["Algebra"])
    return spark.createDataFrame([(r.total_sessions, r.matched_sessions, r.status, ",".join(r.unmeasured))], "total_sessions long, matched_sessions long, status string, unmeasured string")


