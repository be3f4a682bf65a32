"""Plans for routed questions, the capabilities they need, query rewriting, and the public status of an answer."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.providers import Model, until_valid
from .router import Route, normal, protected_tokens

# Plan type, analytics operation, perspectives and report by intent.
PLANS = {
    "STUDENT_FREQUENT_QUESTIONS": ("ANALYTICS_WITH_EVIDENCE", "frequent_student_questions", ("STUDENT",), "STUDENT_FAQ_REPORT"),
    "DIFFICULT_CONCEPTS": ("ANALYTICS_WITH_EVIDENCE", "difficult_concepts", ("STUDENT", "TUTOR"), "DIFFICULTY_REPORT"),
    "RECURRING_MISCONCEPTIONS": ("ANALYTICS_WITH_EVIDENCE", "recurring_misconceptions", ("STUDENT",), "MISCONCEPTION_REPORT"),
    "EXAM_ERROR_PATTERNS": ("ANALYTICS_WITH_EVIDENCE", "exam_error_patterns", ("STUDENT",), "EXAM_ERROR_PATTERN_REPORT"),
    "TUTOR_STRATEGY_PATTERNS": ("ANALYTICS_WITH_EVIDENCE", "tutor_strategy_patterns", ("TUTOR",), "TUTOR_STRATEGY_REPORT"),
    "CONTENT_IMPROVEMENT": ("CONTENT_BRIEF", "content_opportunities", ("STUDENT", "TUTOR"), "CONTENT_IMPROVEMENT_BRIEF"),
    "QUESTION_TUTORING": ("SOCRATIC_TUTORING", None, ("STUDENT", "TUTOR"), "SOCRATIC_TURN"),
}
CO_OCCURRENCE = ("共现", "共同出现", "伴随", "co-occurrence", "cooccur")
#: What each capability needs: a table, and its columns, each under any of its names.
CAPABILITIES = {
    "BUSINESS_ANALYTICS": ("labels", (("label_type",), ("canonical_label",), ("source_session_id", "session_id"))),
    "DIALOGUE_EVIDENCE": ("turns", (("session_id", "intervention_id"), ("turn_id",), ("speaker",), ("text",))),
    "STUDENT_COHORT": ("cohorts", (("session_id",), ("cohort",))),
}


#: What richer capabilities need: whose tables, the table, and its columns, each under any of its names.
REQUIREMENTS = {
    "DIALOGUE_EVIDENCE": ("source", "turns", (("session_id", "intervention_id"), ("turn_id",), ("speaker",), ("text",))),
    "BUSINESS_ANALYTICS": ("analytics", "manifest", (("source_hash", "source_artifact_hash"), ("graph_version", "analytics_version"), ("build_status", "status"))),
    "RETAKE_COHORT": ("analytics", "student_features", (("session_id",), ("student_key",), ("attempt_number",), ("measured_at",))),
    "ABILITY_COHORT": ("analytics", "student_features", (("session_id",), ("student_key",), ("historic_question_count",), ("historic_correctness",), ("measured_at",))),
}


@dataclass(frozen=True)
class Snapshot:
    """Whether a capability is there, and if not, what is missing."""

    capability: str
    available: bool
    coverage: float
    missing: tuple[str, ...] = ()
    source: str = ""


def snapshots(source: dict[str, DataFrame], analytics: dict[str, DataFrame] | None = None) -> dict[str, Snapshot]:
    """Every capability as the tables are just now. Column names count in any case; an empty table is no capability."""
    out = {}
    for name, (whose, table, columns) in REQUIREMENTS.items():
        tables = source if whose == "source" else analytics
        first = sorted(names[0] for names in columns)
        df = (tables or {}).get(table)
        if tables is None:
            missing = (whose, table, *first)
        elif df is None:
            missing = (table, *first)
        else:
            there = {c.lower() for c in df.columns}
            missing = tuple(sorted(names[0] for names in columns if there.isdisjoint(names)))
            if not missing and df.isEmpty():
                missing = (f"{table}:non_empty",)
        out[name] = Snapshot(name, not missing, float(not missing), missing, whose)
    return out


def require(names: list[str], held: dict[str, Snapshot]) -> list[Snapshot]:
    """The named capabilities, in that order; LookupError at the first that isn't there, ValueError at a name that is none."""
    out = []
    for name in names:
        if name not in held:
            raise ValueError(f"unknown capability {name}")
        if not held[name].available:
            raise LookupError(f"{name} lacks {', '.join(held[name].missing)}")
        out.append(held[name])
    return out


@dataclass
class Plan:
    kind: str
    operation: str | None = None
    perspectives: tuple[str, ...] = ()
    report: str | None = None
    filters: list[str] = field(default_factory=list)
    top_k: int = 3
    reason: str | None = None


def inspect(tables: dict[str, DataFrame]) -> dict[str, str]:
    """AVAILABLE, EMPTY, MISSING_COLUMNS or MISSING_TABLE by capability."""
    out = {}
    for name, (table, columns) in CAPABILITIES.items():
        df = tables.get(table)
        if df is None:
            out[name] = "MISSING_TABLE"
        elif not all(any(c in df.columns for c in names) for names in columns):
            out[name] = "MISSING_COLUMNS"
        else:
            out[name] = "EMPTY" if df.isEmpty() else "AVAILABLE"
    return out


def plan(route: Route, capabilities: dict[str, str]) -> Plan:
    """The plan of a resolved route; REJECT with a reason for what can't be answered.

    Filters apply only to questions about a subject, and a question about things that occur together counts pairs.
    """
    if route.status != "RESOLVED":
        return Plan("REJECT", reason=route.status)
    if route.computation == "REJECT":
        return Plan("REJECT", reason="OUTCOME_NOT_MEASURED")
    if route.intent == "STUDENT_COHORT_PATTERNS":
        if capabilities.get("STUDENT_COHORT") != "AVAILABLE":
            return Plan("REJECT", reason="NO_COHORT_DATA")
        return Plan("ANALYTICS_WITH_EVIDENCE", "recurring_misconceptions", ("STUDENT",), "COHORT_REPORT", top_k=route.top_k)
    kind, operation, views, report = PLANS[route.intent]
    needed = ["DIALOGUE_EVIDENCE", *(["BUSINESS_ANALYTICS"] if operation else [])]
    lacking = next((c for c in needed if capabilities.get(c) != "AVAILABLE"), None)
    if lacking:
        return Plan("REJECT", reason=f"{lacking}:{capabilities.get(lacking, 'MISSING_TABLE')}")
    if operation and any(w in normal(route.query) for w in CO_OCCURRENCE):
        operation = "misconception_strategy_pairs"
    return Plan(kind, operation, views, report, route.filters if route.scope == "SUBJECT" else [], route.top_k)


def public_status(stages: dict[str, str]) -> str:
    """One status for an answer from those of its stages: the gravest first."""
    order = ("FAILED", "REJECTED", "NO_MATCHING_SCOPE", "NO_EVIDENCE", "UNMEASURED", "MEASURED")
    return next((s for s in order if s in stages.values()), "UNMEASURED")


def rewrite_with(model: Model, query: str, glossary: list[dict], tries: int = 3) -> dict[str, str]:
    """The query from three perspectives as a model writes them, from the same glossary context; ValueError after so many invalid answers."""
    wanted = {"misconception_query": str, "strategy_query": str, "curriculum_query": str, "extracted_keywords": list}

    def check(answer: object) -> dict[str, str]:
        if not isinstance(answer, dict) or set(answer) != set(wanted):
            raise ValueError(f"the answer must hold {', '.join(wanted)}")
        for name, kind in wanted.items():
            if not isinstance(answer[name], kind) or kind is str and not answer[name].strip():
                raise ValueError(f"{name} must be a {kind.__name__} that isn't blank")
        return {"raw": query, **{name.removesuffix("_query"): answer[name] for name in wanted if name.endswith("_query")}}

    return until_valid(model, [{"role": "user", "content": "\n\n".join(rewrite(query, glossary).values())}], check, tries)


def rewrite(query: str, glossary: list[dict]) -> dict[str, str]:
    """The query as it is and from three perspectives; glossary terms are added, protected tokens stay as written."""
    q = normal(query)
    entries = [g for g in glossary if any(normal(k) in q for k in g["keywords"])]
    terms = list(dict.fromkeys(t for g in entries for t in g.get("terms", g["keywords"])))
    shown = "; ".join(g["subject_path"] for g in entries[:2])
    kept = " ".join(t for t in protected_tokens(query))
    more = " ".join(x for x in (" ".join(terms), kept) if x)
    return {
        "raw": query,
        "misconception": f"student misconception: {query} {more}".strip(),
        "strategy": f"tutor strategy: {query} {more}".strip(),
        "curriculum": f"curriculum: {shown or 'general'} {query} {more}".strip(),
    }
