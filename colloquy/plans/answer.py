"""From a plan to an answer: rows to prompt sections, card slots, citation payloads and judgement. Small values only."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import analytics
from .planner import Plan, inspect, plan, public_status
from .router import Classifier, route


def macro_prompt(question: str, result: analytics.Result) -> str:
    """Sections of a macro answer: question, scope, rows, what is not measured."""
    rows = [" | ".join(f"{k}={v}" for k, v in r.items()) for r in result.rows] or ["no rows"]
    scope = f"{result.matched_sessions} of {result.total_sessions} sessions, filters: {', '.join(result.filters) or 'none'}"
    return "\n".join(["# Question", question, "# Scope", scope, f"# {result.operation} ({result.status})", *rows, "# Not measured", ", ".join(result.unmeasured)])


def card_context(misconception: dict | None, strategy: dict | None, evidence: Iterable[dict], curriculum: str = "") -> str:
    """Four slots: misconception, strategy, evidence, curriculum. An empty slot says so, so none is filled by guess."""
    slot = lambda title, lines: [f"## {title}", *(lines or ["none"])]
    fields = lambda card: [f"{k}: {v}" for k, v in (card or {}).items() if v not in (None, "", [])]
    cited = [f"[{e['evidence_id']}] {e['speaker']}: {e['text']}" for e in evidence]
    return "\n".join([*slot("Misconception", fields(misconception)), *slot("Strategy", fields(strategy)), *slot("Evidence", cited), *slot("Curriculum", [curriculum] if curriculum else [])])


def canonical_payload(payload: dict, catalog: dict[str, str]) -> dict:
    """A generator's payload with ids in full form, citations closed over all ids that claims declare, and role lists from speakers.

    payload: citations, claims (each with evidence_ids); catalog: speaker by evidence id. E1 becomes E001 if that
    is in the catalogue; an id that isn't there in any form raises.
    """

    def full(i: str) -> str:
        padded = f"E{int(i[1:]):03d}" if i[:1] == "E" and i[1:].isdigit() else i
        found = i if i in catalog else padded
        if found not in catalog:
            raise ValueError(f"unknown evidence {i}")
        return found

    claims = [{**c, "evidence_ids": [full(i) for i in c.get("evidence_ids", [])]} for c in payload.get("claims", [])]
    ids = list(dict.fromkeys([*map(full, payload.get("citations", [])), *(i for c in claims for i in c["evidence_ids"])]))
    return {"claims": claims, "citations": ids, "student_ids": [i for i in ids if catalog[i] == "student"], "tutor_ids": [i for i in ids if catalog[i] == "tutor"]}


def judge(score: Callable[[], float] | None, heuristic: Callable[[], float], hit_rate: float | None, allow_heuristic: bool = False) -> dict:
    """The judge's score beside the exact citation rate; without a judge the heuristic counts only where it is allowed."""
    if score is not None:
        return {"score": score(), "source": "judge", "citation_hit_rate": hit_rate}
    if not allow_heuristic:
        raise ValueError("no judge, and a heuristic score isn't allowed")
    return {"score": heuristic(), "source": "heuristic", "citation_hit_rate": hit_rate}


@dataclass
class Answer:
    """What a business question gets: status, plan, rows, references, prompt, and the status of each stage."""

    question: str
    status: str
    plan: Plan
    rows: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    prompt: str = ""
    stages: dict[str, str] = field(default_factory=dict)


def ask(question: str, tables: dict[str, DataFrame], glossary: list[dict] | None = None, top_k: int = 3, classifier: Classifier | None = None) -> Answer:
    """Route, plan, analyse and render one question over tables labels, sessions and turns."""
    r = route(question, glossary, top_k, classifier=classifier)
    p = plan(r, inspect(tables))
    stages = {"route": r.status if r.status == "RESOLVED" else "UNMEASURED" if r.status != "UNSUPPORTED" else "REJECTED", "plan": "MEASURED" if p.kind != "REJECT" else "REJECTED"}
    if r.status in ("NEED_LLM", "UNMEASURED"):
        return Answer(question, "UNMEASURED", p, stages=stages)
    if p.kind == "REJECT":
        return Answer(question, "REJECTED", p, stages=stages)
    if p.operation is None:
        return Answer(question, "UNMEASURED", p, stages=stages | {"analytics": "UNMEASURED"})
    result = analytics.run(p.operation, tables["labels"], tables["sessions"], tables["turns"], p.top_k, p.filters)
    stages |= {"analytics": result.status, "evidence": "MEASURED" if result.refs else "NO_EVIDENCE"}
    return Answer(question, public_status({"analytics": result.status}), p, result.rows, result.refs, macro_prompt(question, result), stages)
