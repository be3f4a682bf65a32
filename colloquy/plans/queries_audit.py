"""Queries of versions, audits and proven choices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import assembly, windows
from ..operators.constraints import Holds, Parity, Refers, Unique, audit, gate
from ..sources import merkle, store
from . import surrogates as sg
from .surrogates import GRAPH, S, T, table, windows_sql

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


# versions of the clients' state, from the log of their changes

_STATE = ("source", "segment", "city", "balance")
_LAST = ("valid_at", "seq", "change_id", "op", *_STATE)
_CUT = "2024-03-01"


def client_state(changes: DataFrame) -> DataFrame:
    """client_id and what its last change says, if that is no deletion. The last change is a maximum, so a client with many is no large group."""
    last = changes.where("client_id is not null and valid_at is not null").groupBy("client_id").agg(F.max(F.struct(*_LAST)).alias("last"))
    return last.where("coalesce(last.op, '') <> 'D'").select("client_id", *[F.col(f"last.{c}").alias(c) for c in _STATE])


def _state_sql(name: str, where: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in _LAST)
    return f"{name} AS (SELECT client_id, {', '.join(_STATE)} FROM (SELECT * FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL AND {where} QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY {order}) = 1) WHERE coalesce(op, '') <> 'D')"


_DIFFER = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _STATE)


@query("g9_version_changes", f"""WITH {_state_sql("a", f"valid_at < '{_CUT}'")}, {_state_sql("b", "true")}
SELECT coalesce(a.client_id, b.client_id) AS client_id, CASE WHEN a.client_id IS NULL THEN 'ADDED' WHEN b.client_id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS status,
CAST(a.client_id IS NOT NULL AS BIGINT) AS n_before, CAST(b.client_id IS NOT NULL AS BIGINT) AS n_after FROM a FULL JOIN b ON a.client_id = b.client_id WHERE a.client_id IS NULL OR b.client_id IS NULL OR {_DIFFER}""")
def version_changes(spark, d):
    """Clients whose state differs between March and the end of the log, from two written versions."""
    changes = table(spark, d, "client_changes")
    versions = merkle.MerkleTable(spark, store.scratch(spark), ["client_id"])
    versions.write("march", client_state(changes.where(f"valid_at < '{_CUT}'")))
    versions.write("end", client_state(changes), parent="march")
    return versions.changes("march", "end")


# the shop's tables as they are: references, keys, ranges


def shop() -> list:
    """What the shop's tables must keep to."""
    return [
        Unique("sale ids are unique", "sales", ("sale_id",)),
        Holds("a sale's status is known", "sales", F.col("status").isin("open", "held", "done")),
        Holds("a sale has a total", "sales", F.col("total") >= 0),
        Holds("a sale arrives after it was made", "sales", F.col("arrived_at") >= F.col("sold_at")),
        Holds("a sale has a client", "sales", F.col("client_id").isNotNull(), hard=False),
        Refers("a sale's client is there", "sales", ("client_id",), "clients", ("client_id",)),
        Refers("a finished sale has lines", "sales", ("sale_id",), "sale_lines", ("sale_id",), among=F.col("status") == "done", hard=False),
        Unique("lines are unique", "sale_lines", ("sale_id", "line_no")),
        Holds("a line's quantity is between 1 and 50", "sale_lines", F.col("quantity").between(1, 50)),
        Holds("a line's discount is at most a tenth", "sale_lines", F.col("discount").between(0, 0.1)),
        Holds("a line has shipped if it was kept", "sale_lines", F.col("shipped_at").isNotNull(), among=F.col("flag") == "kept"),
        Refers("a line's sale is there", "sale_lines", ("sale_id",), "sales", ("sale_id",)),
        Refers("a line's item is there", "sale_lines", ("item_id",), "items", ("item_id",)),
        Refers("a line's vendor is there", "sale_lines", ("vendor_id",), "vendors", ("vendor_id",)),
        Refers("a client's nation is there", "clients", ("nation_id",), "nation", ("n_nationkey",)),
        Refers("a client's master is there", "clients", ("master_id",), "clients", ("client_id",)),
        Holds("a client's address is one", "clients", F.col("email").like("%_@_%._%")),
        Refers("a changed client is there", "client_changes", ("client_id",), "clients", ("client_id",)),
        Unique("change ids are unique", "client_changes", ("change_id",), hard=False),
        Parity("items are those sold", "items", "item_id", "sale_lines", "item_id", hard=False),
        Parity("clients are those of the manifest", "clients", "client_id", "client_manifest", "client_id"),
    ]


SHOP_IDS = {"sales": "sale_id", "sale_lines": "sale_id", "clients": "client_id", "client_changes": "change_id", "items": "item_id"}


def _row(name: str, t: str, kind: str, hard: bool, body: str) -> str:
    return f"SELECT '{name}' AS \"constraint\", '{t}' AS table_name, '{kind}' AS kind, {str(hard).lower()} AS hard, n AS checked, f AS failed, CAST(s AS VARCHAR) AS sample, CASE WHEN f > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({body})"


def _holds(name: str, t: str, own: str, test: str, among: str = "true", hard: bool = True) -> str:
    bad = f"coalesce({among}, false) AND NOT coalesce({test}, false)"
    return _row(name, t, "holds", hard, f"SELECT count(*) FILTER (WHERE {among}) AS n, count(*) FILTER (WHERE {bad}) AS f, min({own}) FILTER (WHERE {bad}) AS s FROM {t}")


def _unique(name: str, t: str, own: str, key: str, hard: bool = True) -> str:
    whole = " AND ".join(f"{k.strip()} IS NOT NULL" for k in key.split(","))
    return _row(name, t, "unique", hard, f"SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS f, min(m) FILTER (WHERE c > 1) AS s FROM (SELECT count(*) AS c, min({own}) AS m FROM {t} WHERE {whole} GROUP BY {key})")


def _refers(name: str, t: str, own: str, columns: str, target: str, target_columns: str, among: str = "true", target_among: str = "true", hard: bool = True) -> str:
    pairs = list(zip(columns.split(", "), target_columns.split(", "), strict=True))
    whole = " AND ".join(f"x.{a} IS NOT NULL" for a, _ in pairs)
    there = f"EXISTS (SELECT 1 FROM {target} y WHERE {target_among} AND {' AND '.join(f'x.{a} = y.{b}' for a, b in pairs)})"
    return _row(name, t, "refers", hard, f"SELECT count(*) AS n, count(*) FILTER (WHERE NOT e) AS f, min(i) FILTER (WHERE NOT e) AS s FROM (SELECT {own} AS i, {there} AS e FROM {t} x WHERE {among} AND {whole})")


_SHOP_SQL = " UNION ALL ".join([
    _unique("sale ids are unique", "sales", "sale_id", "sale_id"),
    _holds("a sale''s status is known", "sales", "sale_id", "status IN ('open', 'held', 'done')"),
    _holds("a sale has a total", "sales", "sale_id", "total >= 0"),
    _holds("a sale arrives after it was made", "sales", "sale_id", "arrived_at >= sold_at"),
    _holds("a sale has a client", "sales", "sale_id", "client_id IS NOT NULL", hard=False),
    _refers("a sale''s client is there", "sales", "sale_id", "client_id", "clients", "client_id"),
    _refers("a finished sale has lines", "sales", "sale_id", "sale_id", "sale_lines", "sale_id", among="status = 'done'", hard=False),
    _unique("lines are unique", "sale_lines", "sale_id", "sale_id, line_no"),
    _holds("a line''s quantity is between 1 and 50", "sale_lines", "sale_id", "quantity BETWEEN 1 AND 50"),
    _holds("a line''s discount is at most a tenth", "sale_lines", "sale_id", "discount BETWEEN 0 AND CAST(0.1 AS DOUBLE)"),
    _holds("a line has shipped if it was kept", "sale_lines", "sale_id", "shipped_at IS NOT NULL", among="flag = 'kept'"),
    _refers("a line''s sale is there", "sale_lines", "sale_id", "sale_id", "sales", "sale_id"),
    _refers("a line''s item is there", "sale_lines", "sale_id", "item_id", "items", "item_id"),
    _refers("a line''s vendor is there", "sale_lines", "sale_id", "vendor_id", "vendors", "vendor_id"),
    _refers("a client''s nation is there", "clients", "client_id", "nation_id", "nation", "n_nationkey"),
    _refers("a client''s master is there", "clients", "client_id", "master_id", "clients", "client_id"),
    _holds("a client''s address is one", "clients", "client_id", "email LIKE '%_@_%._%'"),
    _refers("a changed client is there", "client_changes", "change_id", "client_id", "clients", "client_id"),
    _unique("change ids are unique", "client_changes", "change_id", "change_id", hard=False),
    _row("items are those sold", "items", "parity", False, "SELECT count(*) AS n, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS f, min(coalesce(a, b)) FILTER (WHERE a IS NULL OR b IS NULL) AS s FROM (SELECT DISTINCT item_id AS a FROM items WHERE item_id IS NOT NULL) FULL JOIN (SELECT DISTINCT item_id AS b FROM sale_lines WHERE item_id IS NOT NULL) ON a = b"),
    "SELECT 'clients are those of the manifest', 'clients', 'parity', true, 0, 0, NULL, 'BLOCKED'",
])
_GATE_SQL = "SELECT count(*) AS constraints, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'BLOCKED') AS blocked, CASE WHEN count(*) = 0 OR count(*) FILTER (WHERE hard AND status = 'BLOCKED') > 0 THEN 'BLOCKED' WHEN count(*) FILTER (WHERE hard AND status = 'FAIL') > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict"


def _shop(spark, d) -> DataFrame:
    held = {name: table(spark, d, name) for name in ("sales", "sale_lines", "clients", "client_changes", "items", "vendors", "nation")}
    return audit(held, shop(), SHOP_IDS)


@query("c11_storage_audit", _SHOP_SQL)
def storage_audit(spark, d):
    """The shop's tables against their keys, references and ranges; no manifest of clients is there, so that one is blocked."""
    return _shop(spark, d)


@query("c11_audit_gate", f"{_GATE_SQL} FROM ({_SHOP_SQL})")
def audit_gate(spark, d):
    return gate(_shop(spark, d))


# the graph with faults planted in it

_KINDS = {"MISCONCEPTION": "MISCONCEPTION_EVENT", "EXAM_ERROR": "MISCONCEPTION_EVENT", "CONTENT_OPPORTUNITY": "MISCONCEPTION_EVENT", "TUTOR_STRATEGY": "TUTOR_STRATEGY_EVENT", "DIFFICULTY_SIGNAL": "SESSION", "QUESTION_FUNCTION": "TURN"}


def _allowed() -> dict[str, list[str]]:
    """Labels that each type may have."""
    return {kind: sorted({*sg.TAXONOMY.labels[kind], "UNCLASSIFIED"}) for kind in ("MISCONCEPTION", "EXAM_ERROR", "TUTOR_STRATEGY", "DIFFICULTY_SIGNAL")}


def topology() -> list:
    """What a graph must keep to: ends, labels, provenance, roles, and no event without its labels."""
    out: list = [
        Unique("edge ids are unique", "edges", ("edge_id",)),
        Refers("an edge's source is there", "edges", ("source_node_id",), "nodes", ("node_id",)),
        Refers("an edge's target is there", "edges", ("target_node_id",), "nodes", ("node_id",)),
        Refers("a node has an edge", "nodes", ("node_id",), "ends", ("node_id",)),
        Holds("a node names its turns", "nodes", F.size("source_turn_ids") > 0),
        Refers("evidence of a misconception is a student's turn", "edges", ("target_node_id",), "spoken", ("node_id",), among=(F.col("edge_type") == "EVIDENCED_BY") & F.col("source_node_id").startswith("misconception-event:"), target_among=F.col("speaker") == "student"),
        Refers("evidence of a strategy is a tutor's turn", "edges", ("target_node_id",), "spoken", ("node_id",), among=(F.col("edge_type") == "EVIDENCED_BY") & F.col("source_node_id").startswith("tutor-strategy-event:"), target_among=F.col("speaker") == "tutor"),
    ]
    for kind, labels in _allowed().items():
        out.append(Holds(f"{kind} labels are of the taxonomy", "labels", F.col("canonical_label").isin(*labels), among=F.col("label_type") == kind))
    for kind, node in _KINDS.items():
        out.append(Refers(f"{kind} labels are on a {node}", "labels", ("source_node_id",), "nodes", ("node_id",), among=F.col("label_type") == kind, target_among=F.col("node_type") == node))
    for kind in ("MISCONCEPTION", "EXAM_ERROR", "CONTENT_OPPORTUNITY", "TUTOR_STRATEGY"):
        out.append(Refers(f"each {_KINDS[kind]} has a {kind} label", "nodes", ("node_id",), "labels", ("source_node_id",), among=F.col("node_type") == _KINDS[kind], target_among=F.col("label_type") == kind))
    return out


def _topology_sql() -> str:
    esc = lambda s: s.replace("'", "''")
    parts = [
        _unique("edge ids are unique", "edges", "edge_id", "edge_id"),
        _refers("an edge''s source is there", "edges", "edge_id", "source_node_id", "nodes", "node_id"),
        _refers("an edge''s target is there", "edges", "edge_id", "target_node_id", "nodes", "node_id"),
        _refers("a node has an edge", "nodes", "node_id", "node_id", "ends", "node_id"),
        _holds("a node names its turns", "nodes", "node_id", "len(ids) > 0"),
        _refers("evidence of a misconception is a student''s turn", "edges", "edge_id", "target_node_id", "spoken", "node_id", among="edge_type = 'EVIDENCED_BY' AND starts_with(source_node_id, 'misconception-event:')", target_among="speaker = 'student'"),
        _refers("evidence of a strategy is a tutor''s turn", "edges", "edge_id", "target_node_id", "spoken", "node_id", among="edge_type = 'EVIDENCED_BY' AND starts_with(source_node_id, 'tutor-strategy-event:')", target_among="speaker = 'tutor'"),
    ]
    for kind, labels in _allowed().items():
        known = ", ".join(f"'{esc(x)}'" for x in labels)
        parts.append(_holds(f"{kind} labels are of the taxonomy", "labels", "assignment_id", f"canonical_label IN ({known})", f"label_type = '{kind}'"))
    for kind, node in _KINDS.items():
        parts.append(_refers(f"{kind} labels are on a {node}", "labels", "assignment_id", "source_node_id", "nodes", "node_id", f"label_type = '{kind}'", f"node_type = '{node}'"))
    for kind in ("MISCONCEPTION", "EXAM_ERROR", "CONTENT_OPPORTUNITY", "TUTOR_STRATEGY"):
        parts.append(_refers(f"each {_KINDS[kind]} has a {kind} label", "nodes", "node_id", "node_id", "labels", "source_node_id", f"node_type = '{_KINDS[kind]}'", f"label_type = '{kind}'"))
    planted = """nodes AS (SELECT node_id, node_type, session_id, CASE WHEN node_type = 'TALK_MOVE' AND session_id % 3 = 0 THEN [] ELSE ids END AS ids FROM n WHERE NOT (node_type = 'SUBJECT' AND node_id LIKE '%angles') UNION ALL SELECT 'lonely:' || session_id, 'SESSION', session_id, all_turns FROM g WHERE session_id % 5 = 0),
edges AS (SELECT edge_id, edge_type, a AS source_node_id, CASE WHEN edge_type = 'EVIDENCED_BY' AND session_id % 4 = 0 THEN 'turn:' || session_id || ':1' ELSE b END AS target_node_id FROM e UNION ALL SELECT edge_id, edge_type, a, b FROM e WHERE edge_type = 'ANCHORS' AND session_id % 7 = 0),
labels AS (SELECT assignment_id, source_node_id, label_type, CASE WHEN label_type = 'MISCONCEPTION' AND source_session_id % 6 = 0 THEN 'NO_SUCH_LABEL' ELSE canonical_label END AS canonical_label FROM l WHERE NOT (label_type = 'EXAM_ERROR' AND source_session_id % 8 = 0)),
ends AS (SELECT source_node_id AS node_id FROM edges UNION ALL SELECT target_node_id FROM edges),
spoken AS (SELECT 'turn:' || session_id || ':' || turn_id AS node_id, speaker FROM t)"""
    return f"{GRAPH}, {planted} " + " UNION ALL ".join(parts)


@query("v15_topology_audit", _topology_sql())
def topology_audit(spark, d):
    """The graph of all sessions after faults were planted: nodes gone, alone or without turns, edges twice or to other turns, labels unknown or missing."""
    p, s = sg.projection(spark, d), F.col("source_session_id")
    lonely = p.rows.where("session_id % 5 = 0").select(F.concat(F.lit("lonely:"), F.col("session_id").cast("string")).alias("node_id"), F.lit("SESSION").alias("node_type"), F.col("all_turns").alias("source_turn_ids"))
    bare = (F.col("node_type") == "TALK_MOVE") & (s % 3 == 0)
    nodes = p.nodes().where("not (node_type = 'SUBJECT' and node_id like '%angles')").select("node_id", "node_type", F.when(bare, F.array().cast("array<int>")).otherwise(F.col("source_turn_ids")).alias("source_turn_ids")).unionByName(lonely)
    e = p.edges()
    moved = F.when((F.col("edge_type") == "EVIDENCED_BY") & (s % 4 == 0), F.concat(F.lit("turn:"), s.cast("string"), F.lit(":1"))).otherwise(F.col("target_node_id"))
    columns = ("edge_id", "edge_type", "source_node_id", "target_node_id")
    edges = e.withColumn("target_node_id", moved).select(*columns).unionByName(e.where((F.col("edge_type") == "ANCHORS") & (s % 7 == 0)).select(*columns))
    wrong = F.when((F.col("label_type") == "MISCONCEPTION") & (s % 6 == 0), "NO_SUCH_LABEL").otherwise(F.col("canonical_label"))
    labels = p.assignments().where(~((F.col("label_type") == "EXAM_ERROR") & (s % 8 == 0))).withColumn("canonical_label", wrong).select("assignment_id", "source_node_id", "label_type", "canonical_label")
    # the graph is written once: some thirty constraints read it
    at = store.scratch(spark)
    for name, df in (("nodes", nodes), ("edges", edges), ("labels", labels)):
        df.write.parquet(f"{at}/{name}")
    held = {name: spark.read.parquet(f"{at}/{name}") for name in ("nodes", "edges", "labels")}
    held["ends"] = held["edges"].select(F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    held["spoken"] = sg.turns(spark, d).select(F.concat_ws(":", F.lit("turn"), F.col("session_id").cast("string"), F.col("turn_id").cast("string")).alias("node_id"), "speaker")
    return audit(held, topology(), {"nodes": "node_id", "edges": "edge_id", "labels": "assignment_id"})


# the best units of a pool within a budget

_POOL, _BUDGET, _MOST = 30, 2500, 4
_GROW = lambda a: f"SELECT a.query_id, list_append(a.picked, b.rank) AS picked, a.tokens + b.tokens AS tokens, list_distinct(list_concat(a.keys, b.keys)) AS keys FROM {a} a JOIN p b ON a.query_id = b.query_id AND b.rank > a.picked[-1] AND a.tokens + b.tokens <= {_BUDGET}"


@query("k10_proven_subset", f"""WITH {T}, {S}, {windows_sql(6, 3)}, p AS (SELECT s.question_id AS query_id, w.session_id || '_' || w.start AS id, row_number() OVER (PARTITION BY s.question_id ORDER BY w.session_id, w.start) AS rank, length(w.content) AS tokens, list_transform(w.ids, lambda x: w.session_id || ':' || x) AS keys FROM w JOIN s USING (session_id) QUALIFY rank <= {_POOL}),
k1 AS (SELECT query_id, [rank] AS picked, tokens, keys FROM p WHERE tokens <= {_BUDGET}), k2 AS ({_GROW("k1")}), k3 AS ({_GROW("k2")}), k4 AS ({_GROW("k3")}),
b AS (SELECT query_id, unnest(picked) AS rank FROM (SELECT * FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3 UNION ALL SELECT * FROM k4) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(keys) DESC, tokens, picked) = 1))
SELECT query_id, id FROM b JOIN p USING (query_id, rank)""")
def proven(spark, d):
    """Of each question's first thirty windows those, at most four, that cover most turns in so many signs; by SQL all subsets are tried."""
    w = windows.sliding_windows(sg.turns(spark, d)).join(sg.sessions(spark, d).select("session_id", "question_id"), "session_id")
    sid = F.col("session_id").cast("string")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("session_id", "start"))
    units = w.select(F.col("question_id").alias("query_id"), F.concat_ws("_", sid, "start").alias("id"), rank.alias("rank"), F.length("content").cast("long").alias("tokens"), F.transform("source_turn_ids", lambda t: F.concat_ws(":", sid, t.cast("string"))).alias("turn_keys"))
    return assembly.proven_subset(units.where(F.col("rank") <= _POOL), _BUDGET, _MOST)
