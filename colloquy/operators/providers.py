"""Remote models behind interfaces: embeddings, rerankers and card extractors, with deterministic stand-ins.

A provider is a plain callable over a batch; Spark calls it once for each batch of distinct inputs, and what
it returns is checked before anything uses it.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[tuple[int, float]]]


@dataclass(frozen=True)
class Contract:
    """What an index was built with; vectors of another contract don't compare."""

    provider: str
    model: str
    dimension: int
    version: str

    def check(self, other: Contract) -> None:
        for name in ("provider", "model", "dimension", "version"):
            if getattr(self, name) != getattr(other, name):
                raise ValueError(f"index has {name} {getattr(other, name)!r}, not {getattr(self, name)!r}")

    def key(self, text: str) -> str:
        return hashlib.sha256("\x1f".join((self.provider, self.model, str(self.dimension), self.version, text)).encode()).hexdigest()


def hashed_embedder(dimension: int = 64) -> Embedder:
    """A stand-in: unit vectors from hashed words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                h = hashlib.md5(w.encode()).digest()
                v[h[15] % dimension] += 1.0 if h[14] % 2 == 0 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def _batch(embed: Embedder, texts: list[str], dimension: int, tries: int) -> list[list[float]]:
    for attempt in range(tries):
        try:
            vectors = embed(texts)
            break
        except OSError:
            if attempt + 1 == tries:
                raise
    if len(vectors) != len(texts) or any(len(v) != dimension or not all(map(math.isfinite, v)) for v in vectors):
        raise ValueError("the provider returned vectors of a wrong number, length or value")
    return vectors


def embed_texts(rows: DataFrame, text: str, embed: Embedder, contract: Contract, cache: DataFrame | None = None, batch: int = 64, tries: int = 3) -> DataFrame:
    """cache_key, embedding of each distinct text: those in the cache as they are, the rest from the provider in batches."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(contract.provider), F.lit(contract.model), F.lit(str(contract.dimension)), F.lit(contract.version), F.col(text)), 256)
    wanted = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct().withColumn("cache_key", key if text == "text" else F.sha2(F.concat_ws("\x1f", F.lit(contract.provider), F.lit(contract.model), F.lit(str(contract.dimension)), F.lit(contract.version), F.col("text")), 256))
    todo = wanted if cache is None else wanted.join(cache.select("cache_key"), "cache_key", "left_anti")
    dimension = contract.dimension

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"cache_key": part.cache_key.to_numpy(), "embedding": _batch(embed, part.text.tolist(), dimension, tries)})

    made = todo.select("cache_key", "text").mapInPandas(run, "cache_key string, embedding array<double>")
    if cache is None:
        return made
    return made.unionByName(cache.join(wanted.select("cache_key"), "cache_key", "left_semi").select("cache_key", "embedding"))


def rerank(candidates: DataFrame, model: Reranker) -> DataFrame:
    """query_id, id, reranker_rank, reranker_score; a query's candidates are a few dozen rows, so a query is one group.

    The model must score each candidate once, with finite scores; ties go to the smaller id.
    """

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        got = model(rows["query"].iloc[0], rows["text"].tolist())
        if sorted(i for i, _ in got) != list(range(len(rows))) or not all(math.isfinite(s) for _, s in got):
            raise ValueError("the reranker must score each candidate once with finite scores")
        ordered = sorted(got, key=lambda x: (-x[1], rows.id[x[0]]))
        return pd.DataFrame([(rows.query_id[i], rows.id[i], n, s) for n, (i, s) in enumerate(ordered, 1)], columns=["query_id", "id", "reranker_rank", "reranker_score"])

    return candidates.groupBy("query_id").applyInPandas(score, "query_id long, id string, reranker_rank int, reranker_score double")


Model = Callable[[list[dict[str, str]]], str]


def until_valid(model: Model, messages: list[dict[str, str]], check: Callable[[object], object], tries: int = 3):
    """What check makes of the model's JSON answer. An answer that isn't valid goes back with the reason, so many times; then ValueError."""
    if tries < 1:
        raise ValueError("tries must be positive")
    said, why = list(messages), ""
    for _ in range(tries):
        answer = model(said)
        try:
            return check(json.loads(answer))
        except (ValueError, KeyError, TypeError) as e:
            why = str(e) or type(e).__name__
            said = [*said, {"role": "assistant", "content": answer}, {"role": "user", "content": f"not valid: {why}"}]
    raise ValueError(f"no valid answer in {tries} tries: {why}")


#: Fields of an extracted card, each with its type; a session gives one card of either kind.
CARD_FIELDS = {
    "misconception": {"misconception_name": str, "deep_mechanism": str, "verbatim_student_quotes": list, "source_turn_ids": list},
    "tutor_strategy": {"pedagogical_goal": str, "strategy_category": str, "key_aha_question": str, "source_turn_ids": list},
}


def grounded(payload: object, turns: list[tuple[int, str, str]]) -> dict:
    """An extracted pair of cards, if it is exactly of the schema and its pointers and quotes are those of turns (id, speaker, text)."""
    if not isinstance(payload, dict) or set(payload) != set(CARD_FIELDS):
        raise ValueError("the answer must hold misconception and tutor_strategy")
    text = {i: (speaker, " ".join((t or "").split())) for i, speaker, t in turns}
    for kind, role in (("misconception", "student"), ("tutor_strategy", "tutor")):
        card = payload[kind]
        if not isinstance(card, dict) or set(card) != set(CARD_FIELDS[kind]):
            raise ValueError(f"{kind} must have {', '.join(CARD_FIELDS[kind])}")
        for name, of in CARD_FIELDS[kind].items():
            if not isinstance(card[name], of) or of is str and not card[name].strip():
                raise ValueError(f"{name} must be a {of.__name__} that isn't blank")
        ids = card["source_turn_ids"]
        if not ids or any(text.get(i, ("",))[0] != role for i in ids):
            raise ValueError(f"{kind} must point to turns of the {role}")
        quotes = card["verbatim_student_quotes"] if kind == "misconception" else [card["key_aha_question"]]
        if not quotes or any(not any(" ".join(str(q).split()) in text[i][1] for i in ids) for q in quotes):
            raise ValueError(f"quotes of {kind} must stand in the turns it points to")
    return payload


def extract_cards(turns: DataFrame, model: Model, tries: int = 3) -> DataFrame:
    """session_id, status, payload, reason: a session's pair of cards as JSON if the model gives a valid one, else why not."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = [(int(i), s, t) for i, s, t in rows.sort_values("turn_id")[["turn_id", "speaker", "text"]].itertuples(index=False)]
        script = "\n".join(f"[Turn {i}] {s}: {t}" for i, s, t in own)
        try:
            got = until_valid(model, [{"role": "user", "content": script}], lambda p: grounded(p, own), tries)
            return pd.DataFrame([(key[0], "SUCCESS", json.dumps(got, ensure_ascii=False, sort_keys=True), None)], columns=["session_id", "status", "payload", "reason"])
        except ValueError as e:
            return pd.DataFrame([(key[0], "FAILED", None, str(e))], columns=["session_id", "status", "payload", "reason"])

    return turns.select("session_id", "turn_id", "speaker", "text").groupBy("session_id").applyInPandas(run, "session_id long, status string, payload string, reason string")


def first_turn_extractor(messages: list[dict[str, str]]) -> str:
    """A stand-in: the first turn of each role makes its card; a session without one of the roles gives no valid answer."""
    lines = [re.match(r"\[Turn (\d+)\] (\w+): (.*)", x) for x in messages[0]["content"].split("\n")]
    first = {m[2]: (int(m[1]), m[3].strip()) for m in reversed([m for m in lines if m and m[3].strip()])}
    s, t = first.get("student", (0, "")), first.get("tutor", (0, ""))
    return json.dumps({"misconception": {"misconception_name": s[1], "deep_mechanism": s[1], "verbatim_student_quotes": [s[1]], "source_turn_ids": [s[0]]}, "tutor_strategy": {"pedagogical_goal": t[1], "strategy_category": "Scaffolding", "key_aha_question": t[1], "source_turn_ids": [t[0]]}})


def stream_tokens(tokens: Iterator[str], show: Callable[[str], None]) -> str:
    """The whole of a stream of tokens, each shown as it comes."""
    out = []
    for token in tokens:
        show(token)
        out.append(token)
    return "".join(out)


def overlap_reranker(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """A stand-in: the share of the query's words that a text has."""
    words = set(query.lower().split())
    return [(i, len(words & set(t.lower().split())) / max(len(words), 1)) for i, t in enumerate(texts)]
