"""The rule taxonomy: ordered labels, each with signals that a text may hold. Order is priority."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from .text import any_of

UNCLASSIFIED = "UNCLASSIFIED"

# Version 1 of the labels and of the signals that assign them.
LABELS = {
    "MISCONCEPTION": ("PLACE_VALUE_CONFUSION", "ROUNDING_RULE_CONFUSION", "ORDER_OF_OPERATIONS_CONFUSION", "FRACTION_DENOMINATOR_CONFUSION", "NEGATIVE_SIGN_SCOPE_CONFUSION", "FORMULA_SELECTION_ERROR", "LANGUAGE_INTERPRETATION_ERROR", "OPTION_COMPARISON_ERROR", "UNCLASSIFIED"),
    "EXAM_ERROR": ("CONCEPTUAL_ERROR", "PROCEDURAL_ERROR", "REPRESENTATION_ERROR", "LANGUAGE_INTERPRETATION_ERROR", "CONDITION_OMISSION", "OVERGENERALIZATION_ERROR", "OPTION_COMPARISON_ERROR", "UNCLASSIFIED"),
    "TUTOR_STRATEGY": ("ASK_FOR_REASONING", "PRESS_FOR_ACCURACY", "USE_COUNTER_EXAMPLE", "RESTATE_STUDENT_IDEA", "BREAK_INTO_STEPS", "CONNECT_TO_PRIOR_KNOWLEDGE", "COMPARE_OPTIONS", "CHECK_UNDERSTANDING", "UNCLASSIFIED"),
    "QUESTION_FUNCTION": ("REQUEST_EXPLANATION", "REQUEST_CONFIRMATION", "ASK_NEXT_STEP", "COMPARE_OPTIONS", "RECALL_RULE", "ASK_DEFINITION", "EXPRESS_UNCERTAINTY", "OTHER"),
    "DIFFICULTY_SIGNAL": ("REPEATED_ATTEMPTS", "EXPLICIT_UNCERTAINTY", "SELF_CORRECTION", "UNCLASSIFIED"),
    "CONTENT_OPPORTUNITY": ("ADD worked_example", "CLARIFY_LANGUAGE", "ADD_OPTION_COMPARISON", "UNCLASSIFIED"),
}
SIGNALS = {
    "PLACE_VALUE_CONFUSION": ("place value", "digit"),
    "ROUNDING_RULE_CONFUSION": ("round",),
    "ORDER_OF_OPERATIONS_CONFUSION": ("order of operations",),
    "FRACTION_DENOMINATOR_CONFUSION": ("denominator",),
    "NEGATIVE_SIGN_SCOPE_CONFUSION": ("negative sign",),
    "FORMULA_SELECTION_ERROR": ("wrong formula",),
    "ASK_FOR_REASONING": ("why",),
    "PRESS_FOR_ACCURACY": ("check", "correct"),
    "USE_COUNTER_EXAMPLE": ("counterexample",),
    "BREAK_INTO_STEPS": ("step",),
    "COMPARE_OPTIONS": ("option", "which"),
    "CHECK_UNDERSTANDING": ("understand",),
    "EXPLICIT_UNCERTAINTY": ("don't know", "not sure"),
    "REPEATED_ATTEMPTS": ("again", "still"),
    "SELF_CORRECTION": ("wait", "actually"),
}
QUESTION_RULES = (
    ("REQUEST_EXPLANATION", ("why", "explain")),
    ("REQUEST_CONFIRMATION", ("is this", "right")),
    ("ASK_NEXT_STEP", ("next", "what do i do")),
    ("COMPARE_OPTIONS", ("which", "option")),
    ("RECALL_RULE", ("rule", "formula")),
    ("ASK_DEFINITION", ("what is",)),
    ("EXPRESS_UNCERTAINTY", ("not sure", "don't know", "uncertain")),
)


@dataclass(frozen=True)
class Taxonomy:
    """Labels by type in order of priority, and signals by label; the defaults are version 1."""

    version: str = "graph-taxonomy-v1"
    labels: dict[str, tuple[str, ...]] = field(default_factory=lambda: LABELS)
    signals: dict[str, tuple[str, ...]] = field(default_factory=lambda: SIGNALS)
    question_rules: tuple = QUESTION_RULES

    def _hit(self, label: str, text: Column) -> Column:
        return any_of([F.contains(text, F.lit(s.lower())) for s in self.signals.get(label, ())])

    def first(self, kind: str, text: Column) -> Column:
        """The first label of a type that a lower-case text has a signal of, else UNCLASSIFIED."""
        out = F.lit(UNCLASSIFIED)
        for label in reversed(self.labels[kind]):
            if self.signals.get(label):
                out = F.when(self._hit(label, text), F.lit(label)).otherwise(out)
        return out

    def every(self, kind: str, text: Column) -> Column:
        """All labels of a type that a lower-case text has a signal of, or UNCLASSIFIED alone."""
        found = F.array_compact(F.array(*[F.when(self._hit(x, text), F.lit(x)) for x in self.labels[kind] if self.signals.get(x)] or [F.lit(None).cast("string")]))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNCLASSIFIED)))

    def question_function(self, text: Column) -> Column:
        """By the ordered rules for questions, else OTHER."""
        out = F.lit("OTHER")
        for label, signals in reversed(self.question_rules):
            out = F.when(any_of([F.contains(text, F.lit(s)) for s in signals]), F.lit(label)).otherwise(out)
        return out

    def content_opportunity(self, text: Column, has_detail: Column) -> Column:
        """Options first, language next, then whatever has a mechanism or steps."""
        return (
            F.when(F.contains(text, F.lit("option")) | F.contains(text, F.lit("选择")), F.lit("ADD_OPTION_COMPARISON"))
            .when(F.contains(text, F.lit("language")) | F.contains(text, F.lit("英语")), F.lit("CLARIFY_LANGUAGE"))
            .when(has_detail, F.lit("ADD worked_example"))
            .otherwise(F.lit(UNCLASSIFIED))
        )
