"""Routes of whole tables of texts: one automaton a task finds every word in one pass, and rules are columns over what it found.

`router.route` answers one question; `routes` gives the same for each row of a table, with any vocabulary.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from . import router
from .planner import CO_OCCURRENCE, PLANS
from .router import normal

#: Texts whose finds a task holds at once.
ROWS = 128
#: What a task reports of a text.
FOUND = "words array<struct<kind string, name string, word string, n long, first long>>, tokens array<string>, top int, session string, question_ids array<string>"


@dataclass(frozen=True)
class Vocabulary:
    """The words that rules know. Glossary entries are pairs of keywords and a subject path; marks that are left out never hold."""

    signals: dict[str, tuple[str, ...]]
    strong: dict[str, tuple[str, ...]]
    marks: dict[str, tuple[str, ...]]
    short_strong: tuple[str, ...] = ()
    unsupported: tuple[str, ...] = ()
    elapsed: tuple[str, ...] = ()
    together: tuple[str, ...] = CO_OCCURRENCE
    glossary: tuple[tuple[tuple[str, ...], str], ...] = ()
    top_words: tuple[str, ...] = router.TOP_WORDS
    session_words: tuple[str, ...] = router.SESSION_WORDS
    id_words: tuple[str, ...] = router.ID_WORDS

    def groups(self) -> dict[tuple[str, str], tuple[str, ...]]:
        """Words by kind and name; within a group a longer word claims its place from those inside it."""
        single = {"unsupported": self.unsupported, "elapsed": self.elapsed, "together": self.together, "id": self.id_words}
        return {
            **{("signal", k): w for k, w in self.signals.items()},
            **{("strong", k): w for k, w in self.strong.items()},
            **{("mark", k): w for k, w in self.marks.items()},
            **{(k, ""): w for k, w in single.items()},
            **{("topic", str(i)): w for i, (w, _) in enumerate(self.glossary)},
        }


#: The router's own words.
OWN = Vocabulary(router.SIGNALS, router.STRONG, router.MARKS, router.SHORT_STRONG, router.UNSUPPORTED, router.ELAPSED)


class Finder:
    """All words of all groups in one automaton; a text is read once however many there are."""

    def __init__(self, groups: dict[tuple[str, str], tuple[str, ...]]) -> None:
        owners: dict[str, list[tuple[int, str]]] = defaultdict(list)
        self.groups = list(groups)
        for g, words in enumerate(groups.values()):
            seen = {}
            for w in words:
                seen.setdefault(normal(w), w)  # of words that are the same when normal, the first counts
            for n, w in seen.items():
                if n:
                    owners[n].append((g, w))
        self.automaton = ahocorasick.Automaton()
        for n, own in owners.items():
            self.automaton.add_word(n, (len(n), own))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, text: str) -> list[tuple[str, str, str, int, int]]:
        """kind, name, word, number of own places and the first of them, for words that stand in a normal text in their own right."""
        if self.empty or not text:
            return []
        spans: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        for last, (size, own) in self.automaton.iter(text):
            for g, w in own:
                spans[g].append((last + 1 - size, -last - 1, w))
        out = []
        for g in sorted(spans):
            places: dict[str, list[int]] = {}
            reach = 0
            for start, end, w in sorted(spans[g]):
                if -end > reach:  # no earlier start, nor a longer word from here, reaches as far
                    reach = -end
                    places.setdefault(w, [0, start])[0] += 1
            out += [(*self.groups[g], w, n, first) for w, (n, first) in places.items()]
        return out


def _read(batches: Iterator[pd.Series], finder: Finder, v: Vocabulary) -> Iterator[pd.DataFrame]:
    """FOUND of texts, at most ROWS at once: what is found in a text can be larger than the text."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            rows = []
            for raw in batch.iloc[start : start + ROWS]:
                raw = raw or ""
                plain = normal(raw)
                words = finder.find(plain)
                session = router.session_in(plain, v.session_words)
                ids = re.findall(r"\d{5,}", raw) if any(w[0] == "id" for w in words) else []
                rows.append(([dict(zip(("kind", "name", "word", "n", "first"), w, strict=True)) for w in words], router.protected_tokens(raw), router.top_in(plain, v.top_words), None if session is None else str(session), ids))
            yield pd.DataFrame(rows, columns=["words", "tokens", "top", "session", "question_ids"]).astype({"top": "Int32"})


def found(text: Column, vocabulary: Vocabulary = OWN) -> Column:
    """What stands in a text (null: empty): FOUND. Bounded by the vocabulary, but for the tokens."""
    groups, v = vocabulary.groups(), vocabulary

    @F.pandas_udf(FOUND)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _read(batches, Finder(groups), v)

    return read(text.cast("string"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _fits(rule: str, facts: dict[str, Column]) -> Column:
    """A rule as a condition: all parts hold, a|b is either, !a is none."""
    parts = [~facts[p[1:]] if p[0] == "!" else _any([facts[x] for x in p.split("|")]) for p in rule.split()]
    return reduce(lambda a, b: a & b, parts)


def _first(rules: tuple[tuple[str, str], ...], facts: dict[str, Column]) -> Column:
    """The name of the first rule that fits, or null."""
    return F.coalesce(*[F.when(_fits(rule, facts), name) for name, rule in rules])


def _names(values: list[Column]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*values)))


def routes(texts: DataFrame, vocabulary: Vocabulary = OWN, text: str = "text", top_k: int = 3, longest: int | None = 2000, classifier: router.Classifier | None = None) -> DataFrame:
    """The columns of texts, and how each text is understood: the fields of `router.Route`, with points, strong, session and question_ids.

    A blank or null text, and one over `longest` characters (None: no bound), has the status INVALID. Repeated rows are
    each answered; an empty table has no answers. Columns of texts that have a name of the result's raise ValueError.
    """
    clash = {"points", "strong", "intent", "status", "scope", "computation", "confidence", "source", "secondary", "candidates", "filters", "tokens", "top_k", "perspectives", "ambiguous", "session", "question_ids", "together", "_f", "_marks", "_d"} & set(texts.columns)
    if clash:
        raise ValueError(f"texts has columns of the result's: {', '.join(sorted(clash))}")
    v, own, index = vocabulary, [F.col(f"`{c}`") for c in texts.columns], {i: n for n, i in enumerate(router.PRIORITY)}

    def words(kind: str, more: Callable[[Column], Column] = lambda w: F.lit(True)) -> Column:
        return F.filter("_f.words", lambda w: (w["kind"] == kind) & more(w))

    def named_as(intent: str) -> Callable[[Column], Column]:
        return lambda w: w["name"] == intent

    def points(intent: str) -> Column:
        strong = lambda w: (F.length(w["word"]) > 2) | w["word"].isin(*v.short_strong, "")
        return F.aggregate(words("signal", named_as(intent)), F.lit(0), lambda a, w: a + F.when(strong(w), 3).otherwise(1))

    paths = F.array(*[F.lit(p) for _, p in v.glossary]) if v.glossary else F.array().cast("array<string>")
    timed = F.exists("_f.words", lambda w: w["kind"] == "elapsed")
    topics = F.transform(words("topic", lambda w: ~(timed & (w["word"] == "时间"))), lambda w: F.get(paths, w["name"].cast("int")))
    read = texts.select(*own, found(F.col(f"`{text}`"), v).alias("_f")).select(
        *own, "_f", F.transform(words("mark"), lambda w: w["name"]).alias("_marks"), F.array(*[points(i) for i in router.PRIORITY]).alias("_points"),
        F.array_distinct(topics).alias("filters"), F.col("_f.tokens").alias("tokens"), F.coalesce("_f.top", F.lit(top_k)).alias("top_k"),
        F.col("_f.session").alias("session"), F.col("_f.question_ids").alias("question_ids"),
        F.exists("_f.words", lambda w: w["kind"] == "unsupported").alias("_unsupported"), F.exists("_f.words", lambda w: w["kind"] == "together").alias("together"),
    )
    facts = {m: F.array_contains("_marks", m) for m in router.MARKS}
    facts |= {"tokens": F.size("tokens") > 0, "filters": F.size("filters") > 0, "formula": F.exists("tokens", lambda t: ~t.rlike(r"^\p{Nd}+$"))}
    named = [F.when(F.size(words("strong", named_as(i))) > 0, i) for i in v.strong]
    shaped = [F.when(_fits(rule, facts), i) for i, rule in router.SHAPES]
    read = read.select("*", _names(named + shaped).alias("strong"))

    at = lambda i: F.get("_points", F.lit(index[i]))
    beside = lambda i: (F.get("strong", F.lit(0)) == "QUESTION_TUTORING") & F.lit(i in ("TUTOR_STRATEGY_PATTERNS", "CONTENT_IMPROVEMENT"))
    rivals = _names([F.when((at(i) > 1) & ~F.array_contains("strong", i) & ~beside(i), i) for i in router.PRIORITY])
    order = F.array_sort(F.filter(F.transform("_points", lambda n, k: F.struct((-n).alias("n"), k.alias("k"))), lambda x: x["n"] < 0))
    read = read.select("*", rivals.alias("_rivals"), order.alias("_order"), _first(router.COMBINED, facts).alias("_combined"))
    name_of = lambda k: F.get(F.array(*[F.lit(i) for i in router.PRIORITY]), k)
    lead, next_ = -F.get("_order", F.lit(0))["n"], F.coalesce(-F.get("_order", F.lit(1))["n"], F.lit(0))
    n_strong, none = F.size("strong"), F.array().cast("array<string>")
    sure = F.coalesce("_combined", F.get("strong", F.lit(0)))
    nth = F.array_position(F.array(*[F.lit(i) for i in router.PRIORITY]), sure).cast("int") - 1
    near = F.transform(F.filter("_order", lambda x: -x["n"] >= lead - 1), lambda x: name_of(x["k"]))

    def outcome(intent: Column | None, score: Column | int, second: Column | int, candidates: Column) -> Column:
        known = F.lit(None).cast("string") if intent is None else intent
        return F.struct(known.alias("intent"), F.lit(score).cast("int").alias("score"), F.lit(second).cast("int").alias("second"), candidates.alias("candidates"))

    decided = (
        F.when(n_strong > 1, outcome(None, 0, 0, F.col("strong")))
        .when((n_strong == 1) & (F.size("_rivals") > 0), outcome(None, 0, 0, F.concat("strong", "_rivals")))
        .when(sure.isNotNull(), outcome(sure, F.greatest(F.get("_points", nth), F.lit(4)), 0, none))
        .when(F.size("_order") == 0, outcome(None, 0, 0, none))
        .when((F.size("_order") == 1) | (lead - next_ > 1), outcome(name_of(F.get("_order", F.lit(0))["k"]), lead, next_, none))
        .otherwise(outcome(None, 0, 0, near))
    )
    blank = F.coalesce(F.length(F.regexp_replace(F.col(f"`{text}`"), r"(?U)\s+", "")), F.lit(0)) == 0
    invalid = blank | (F.length(F.col(f"`{text}`")) > longest if longest is not None else F.lit(False))
    early = F.when(invalid, "INVALID").when(F.col("_unsupported"), "UNSUPPORTED")
    read = read.select("*", decided.alias("_d"), early.alias("_early"))
    asked = read.select("*", (_classified(F.col(f"`{text}`"), F.col("_early").isNull() & F.col("_d.intent").isNull(), classifier) if classifier else F.lit(None).cast("struct<intent: string, score: int, other: string, failed: boolean>")).alias("_c"))

    from_rules = F.col("_d.intent").isNotNull()
    intent = F.when(F.col("_early").isNull(), F.coalesce("_d.intent", "_c.intent"))
    r = asked.select("*", intent.alias("_intent"), F.when(from_rules, F.col("_d.score")).otherwise(F.col("_c.score")).alias("_score"), F.when(from_rules, F.col("_d.second")).otherwise(0).alias("_second"))
    facts |= {i: F.col("_intent") == i for i in router.PRIORITY}
    solved = F.col("_intent").isNotNull()
    r = r.select("*", F.when(solved, F.coalesce(_first(router.SCOPES, facts), F.lit("CORPUS"))).otherwise("CORPUS").alias("scope"))
    micro = facts["QUESTION_TUTORING"] | (F.col("scope").isin("CASE", "QUESTION") & facts["one_case"])
    reject = facts["STUDENT_COHORT_PATTERNS"] & facts["outcome"]
    also = F.when(~F.col("_intent").isin("TUTOR_STRATEGY_PATTERNS", "CONTENT_IMPROVEMENT") & facts["tutor"], "TUTOR_STRATEGY_PATTERNS")
    gap = F.col("_score") - F.col("_second")
    both = F.array(F.lit("STUDENT"), F.lit("TUTOR"))
    views = F.when(F.col("_intent").isin("DIFFICULT_CONCEPTS", "CONTENT_IMPROVEMENT", "QUESTION_TUTORING"), both).when(facts["TUTOR_STRATEGY_PATTERNS"], F.array(F.lit("TUTOR"))).otherwise(F.array(F.lit("STUDENT")))
    status = F.coalesce("_early", F.when(solved, "RESOLVED"), F.when(F.coalesce("_c.failed", F.lit(False)), "UNMEASURED"), F.lit("NEED_LLM"))
    return r.select(
        *own, "_points", "strong", F.when(solved, F.col("_intent")).when(F.col("_early") == "UNSUPPORTED", "UNSUPPORTED").otherwise("UNRESOLVED").alias("intent"), status.alias("status"), "scope",
        F.when(F.col("_early").isNotNull(), "REJECT").when(solved & micro, "MICRO").when(solved & reject, "REJECT").otherwise("HYBRID").alias("computation"),
        F.when(F.col("_early") == "UNSUPPORTED", "HIGH").when(solved & (F.col("_score") >= 4) & (gap >= 2), "HIGH").when(solved & (F.col("_score") >= 3) & (gap >= 1), "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(solved & ~from_rules, "classifier").otherwise("deterministic").alias("source"),
        F.when(solved, F.slice(_names([F.when(F.col("_c.other") != F.col("_intent"), F.col("_c.other")), also]), 1, 1)).otherwise(none).alias("secondary"),
        F.when(solved, F.array("_intent")).when(F.col("_early").isNull(), F.col("_d.candidates")).otherwise(none).alias("candidates"),
        "filters", "tokens", "top_k", views.alias("perspectives"), F.when(solved, n_strong != 1).otherwise(F.col("_early").isNull()).alias("ambiguous"), "session", "question_ids", "together",
    ).withColumnRenamed("_points", "points")


def _classified(text: Column, open_: Column, classifier: router.Classifier) -> Column:
    """What a classifier says of texts that the rules leave open; a failed call, or an unknown intent, is no answer."""

    @F.pandas_udf("intent string, score int, other string, failed boolean")
    def ask(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows = []
        for t, w in zip(texts, wanted, strict=True):
            intent, score, other = None, None, None
            if w:
                try:
                    intent, certainty, other = classifier(t, router.PRIORITY)
                    score = 4 if certainty >= 0.8 else 3
                except Exception:  # a failed call is unmeasured, not a default intent
                    intent = None
                if intent not in router.PRIORITY:
                    intent, score, other = None, None, None
            rows.append((intent, score, other, bool(w) and intent is None))
        return pd.DataFrame(rows, columns=["intent", "score", "other", "failed"]).astype({"score": "Int32", "intent": object, "other": object})

    return ask(text, open_)


def plans(routed: DataFrame, capabilities: dict[str, str]) -> DataFrame:
    """routed, with the kind of plan, its operation and the reason of a rejection, as `planner.plan` gives them."""
    intent = F.col("intent")
    ready = lambda c: capabilities.get(c) == "AVAILABLE"
    cohort = intent == "STUDENT_COHORT_PATTERNS"
    case = lambda n: F.coalesce(*[F.when(intent == i, p[n]) for i, p in PLANS.items()])
    operation = case(1)
    lacking = lambda c: F.lit(f"{c}:{capabilities.get(c, 'MISSING_TABLE')}")
    reason = (
        F.when(F.col("status") != "RESOLVED", F.col("status"))
        .when(F.col("computation") == "REJECT", "OUTCOME_NOT_MEASURED")
        .when(cohort & F.lit(not ready("STUDENT_COHORT")), "NO_COHORT_DATA")
        .when(~cohort & F.lit(not ready("DIALOGUE_EVIDENCE")), lacking("DIALOGUE_EVIDENCE"))
        .when(~cohort & operation.isNotNull() & F.lit(not ready("BUSINESS_ANALYTICS")), lacking("BUSINESS_ANALYTICS"))
    )
    out = routed.select("*", reason.alias("reason"))
    done = F.col("reason").isNull()
    return out.select(
        "*", F.when(~done, "REJECT").when(cohort, "ANALYTICS_WITH_EVIDENCE").otherwise(case(0)).alias("plan"),
        F.when(done & cohort, "recurring_misconceptions").when(done & F.col("together") & operation.isNotNull(), "misconception_strategy_pairs").when(done, operation).alias("operation"),
    )
