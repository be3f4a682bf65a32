"""Cards met by a set of queries where they are read: pairs are never joined or shuffled, and only those that score are made.

A set that doesn't fit into a task is joined (`retrieval.card_scores`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Queries that go to every task at most, and their words, numbers and ids together; cards that are scored at a time.
QUERIES, WORDS, ROWS = 2_000, 100_000, 256
#: Pairs that are held before those beyond the limit go.
HELD = 100_000
FEATURES = ("exact_question", "numeric_overlap", "question_prefix", "question_overlap", "domain_overlap", "lexical_overlap", "lane_bias", "score")
PAIR = "number:int," + ",".join(f"{c}:{'long' if c == 'score' else 'int'}" for c in FEATURES)


class _Met:
    """What cards share with queries: a table from what a query has to the queries that have it."""

    def __init__(self, of_query: list) -> None:
        held = sorted({(v, q) for q, values in enumerate(of_query) for v in values or ()})
        self.values = sorted({v for v, _ in held})
        self.at = {v: i for i, v in enumerate(self.values)}
        self.query = np.array([q for _, q in held], np.int64)
        self.first = np.searchsorted([self.at[v] for v, _ in held], np.arange(len(self.values) + 1))
        self.many = len(of_query)

    def count(self, row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """How many of a row's values (their numbers here; -1: none) each query has."""
        row, value = row[value >= 0], value[value >= 0]
        n = self.first[value + 1] - self.first[value]
        each = np.repeat(np.arange(len(n)), n)
        query = self.query[np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + self.first[value][each]]
        return np.bincount(row[each] * self.many + query, minlength=rows * self.many).reshape(rows, self.many)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows of a list column's values, and the values."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _first(flat: dict[str, np.ndarray], lane: np.ndarray, session: np.ndarray, limit: int) -> np.ndarray:
    """Places of pairs that can be among the first of their query and lane: the order of `retrieval.card_order` up to the id of a card, which stays open."""
    numeric = flat["numeric_overlap"]
    keys = [flat["number"], lane, -numeric, -flat["question_prefix"], np.where(numeric > 0, session, 10**9), -flat["question_overlap"], -flat["domain_overlap"], -flat["lexical_overlap"], session]
    order = np.lexsort(keys[::-1])
    changed = lambda of: np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in of], axis=0)])
    place = np.arange(len(order))
    start = lambda new: np.maximum.accumulate(np.where(new, place, 0))
    return np.sort(order[start(changed(keys)) - start(changed(keys[:2])) < limit])


def scores(cards: DataFrame, asked: list, fragment: int, limit: int | None = None) -> DataFrame:
    """number (of the query), chunk_id, card_type, session_id and FEATURES of pairs that score.

    cards: chunk_id, card_type, session_id, question_id, c_question, c_words, c_fragment, c_digits, c_domain (numbers of its
    domain words); asked: rows of `retrieval._asked` with q_domain. With a limit, pairs that can't be among so many of
    their query and lane go where they are made.
    """
    words, domain = _Met([r.q_words for r in asked]), _Met([r.q_domain for r in asked])
    numbers, ids = _Met([r.q_numbers for r in asked]), _Met([r.q_ids for r in asked])
    lanes = _Met([[r.q_lane] if r.q_lane else [] for r in asked])
    by_id = np.array([bool(r.q_by_id) for r in asked], bool)
    starts: dict[str, list[tuple[str, int]]] = {}
    for q, r in enumerate(asked):
        if len(r.q_fragment) >= fragment:
            starts.setdefault(r.q_fragment[:fragment], []).append((r.q_fragment, q))
    by_two: dict[str, list[str]] = {}
    for s in numbers.values:
        by_two.setdefault(s[:2], []).append(s)

    def matrix(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        n = part.num_rows
        vocabulary = pa.array(words.values, pa.string())
        column = lambda name: part.column(part.schema.get_field_index(name))

        def shared(name: str) -> np.ndarray:
            row, values = _lists(column(name))
            return words.count(row, pc.fill_null(pc.index_in(values, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64), n)

        def told(met: _Met, values: list[list]) -> np.ndarray:
            found = [(i, met.at.get(v, -1)) for i, own in enumerate(values) for v in own if v is not None]
            found = np.array(found, np.int64).reshape(-1, 2)
            return met.count(found[:, 0], found[:, 1], n)

        digits = column("c_digits").to_pylist()
        seen = [[s for two in {d[i : i + 2] for i in range(len(d) - 1)} & by_two.keys() for s in by_two[two] if s in d] for d in digits]
        prefix = np.zeros((n, len(asked)), np.int64)
        for i, text in enumerate(column("c_fragment").to_pylist()):
            for own, q in starts.get(text[:fragment], ()):
                if text.startswith(own):
                    prefix[i, q] = len(own)
        out = {
            "exact_question": told(ids, [[x] for x in column("question_id").to_pylist()]), "numeric_overlap": told(numbers, seen), "question_prefix": prefix, "question_overlap": shared("c_question"),
            "domain_overlap": told(domain, column("c_domain").to_pylist()), "lexical_overlap": shared("c_words"), "lane_bias": told(lanes, [[x] for x in column("card_type").to_pylist()]) * 100,
        }
        by = {"exact_question": 1000, "numeric_overlap": 1000, "question_prefix": 100, "question_overlap": 10, "domain_overlap": 20, "lane_bias": 1, "lexical_overlap": 1}
        out["score"] = sum(out[c] * w for c, w in by.items())
        out["score"] = np.where(by_id & (out["exact_question"] == 0), 0, out["score"])
        return out

    def listed(number: np.ndarray, flat: dict[str, np.ndarray], n: np.ndarray) -> pa.ListArray:
        fields = [pa.array(number.astype(np.int32))] + [pa.array(flat[c].astype(np.int64 if c == "score" else np.int32)) for c in FEATURES]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["number", *FEATURES]))

    names = ["chunk_id", "card_type", "session_id"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Table, dict[str, np.ndarray]]] = []
        many = 0

        def cut() -> tuple[pa.Table, dict[str, np.ndarray]]:
            told = pa.concat_tables([t for t, _ in held])
            flat = {c: np.concatenate([f[c] for _, f in held]) for c in ("number", *FEATURES)}
            if not told.num_rows:
                return told, flat
            lane = pc.dictionary_encode(told["card_type"].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            session = pc.fill_null(told["session_id"], np.iinfo(np.int64).min).to_numpy()
            at = _first(flat, lane, session, limit)
            return told.take(pa.array(at)), {c: v[at] for c, v in flat.items()}

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = matrix(part)
                r, q = np.nonzero(own["score"] > 0)
                flat = {c: v[r, q] for c, v in own.items()}
                told = pa.Table.from_batches([part.select(names)])
                if limit is None:
                    n = np.bincount(r, minlength=part.num_rows)
                    yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in told.columns], listed(q, flat, n)], [*names, "pairs"])
                    continue
                held.append((told.take(pa.array(r)), flat | {"number": q}))
                many += len(r)
                if many > HELD:
                    held[:] = [cut()]
                    many = 0
        if held:
            told, flat = cut()
            arrays = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in told.columns]
            yield pa.RecordBatch.from_arrays([*arrays, listed(flat["number"], flat, np.ones(told.num_rows, np.int64))], [*names, "pairs"])

    kinds = {c: cards.schema[c].dataType.simpleString() for c in names} | {"session_id": "long"}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", pairs array<struct<{PAIR}>>"
    rows = cards.withColumn("session_id", F.col("session_id").cast("long")).select(*names, "question_id", "c_question", "c_words", "c_fragment", "c_digits", "c_domain")
    return rows.mapInArrow(met, schema).select(*names, F.inline("pairs"))
