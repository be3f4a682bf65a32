"""Reranking and assembly: boosted scores, diversity, parent facts, catalogues, and budgets."""

from __future__ import annotations

from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..sources.store import scratch


def boosted(base: Column, evidence: Column, aha: Column, keyword_share: Column, raw_rank: Column, reranked: Column | None = None) -> Column:
    """Relevance with what supports it: 30 times the fused score, one at most, or a reranker's score within 0..1."""
    start = F.least(F.lit(1.0), base * 30) if reranked is None else F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), reranked)), F.least(F.lit(1.0), base * 30))
    bonus = F.when(evidence > 0, 0.10).otherwise(0.0) + F.when(F.length(F.trim(F.coalesce(aha, F.lit("")))) > 5, 0.05).otherwise(0.0)
    return F.round(start + bonus + 0.15 * keyword_share + F.coalesce(0.50 / raw_rank, F.lit(0.0)), 5)


#: Selected sets that a candidate meets in each round but the last, which meets all; and candidates of a query that set its bound.
ROUNDS, PILOTS = (16, 256), 2
#: Overlaps that differ by less are settled by the last round.
NEAR = 1e-7
#: Selected sets in one row; rows of them, and candidates, that go to every task at most; parts of a query's candidates beyond that.
PACK, PACKS, FEW, PARTS = 64, 256, 10_000, 8


def _likest(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """query_id, id, like: the greatest overlap of a candidate's words with its query's held sets.

    The side that is small goes to every task. If neither is, a query's candidates are dealt into parts, which meet its sets one by one.
    """
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = candidates.select("query_id", "id", "w")
    packs = held.groupBy("query_id", (F.col("n") / PACK).cast("int").alias("pack")).agg(F.collect_list("v").alias("s"))
    if packs.limit(PACKS + 1).count() <= PACKS:
        met = rows.repartition(n, "query_id", "id").join(F.broadcast(packs), "query_id")
    elif rows.limit(FEW + 1).count() <= FEW:
        met = packs.repartition(n, "query_id", "pack").join(F.broadcast(rows), "query_id")
    else:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
        met = dealt.join(packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["query_id", "part"])
    shared = lambda x: F.size(F.array_intersect("w", x))
    # both are sets, so what they hold together follows from what they share
    like = lambda x: F.coalesce(F.try_divide(shared(x), F.size("w") + F.size(x) - shared(x)), F.lit(0.0))
    return met.groupBy("query_id", "id").agg(F.max(F.array_max(F.transform("s", like))).alias("like"))


def mmr_best(candidates: DataFrame, selected: DataFrame, mix: float = 0.7) -> DataFrame:
    """The best candidate of each query: mix of its score less its greatest word overlap with what is selected; ties to the first id.

    candidates: query_id, id, score, text; selected: query_id, text. What a candidate overlaps with some of the selected
    bounds it from above, so rounds over growing parts of these leave only candidates that can still be the best, and
    those alone meet all. Values are compared to nine digits.
    """
    spark = candidates.sparkSession
    folder = scratch(spark)

    def kept(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    value = F.round(F.lit(mix) * F.col("score") - F.lit(1 - mix) * F.coalesce("like", F.lit(0.0)), 9)
    words = candidates.select("query_id", "id", "score", F.array_sort(tx.word_set(F.col("text"))).alias("w"))
    # equal words and scores differ by their ids alone
    left = kept("candidates", words.groupBy("query_id", "score", "w").agg(F.min("id").alias("id")))
    sets = selected.select("query_id", F.array_sort(tx.word_set(F.col("text"))).alias("v")).distinct()
    held = kept("held", sets.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.xxhash64("v"), "v")) - 1))
    by = Window.partitionBy("query_id")
    for i, most in enumerate(ROUNDS):
        if not held.where(F.col("n") >= most).limit(1).count():
            break
        known = kept(f"known{i}", left.join(_likest(left, held.where(F.col("n") < most)), ["query_id", "id"], "left").withColumn("mmr", value))
        first = known.withColumn("k", F.row_number().over(by.orderBy(F.desc("mmr"), "id"))).where(F.col("k") <= PILOTS).select("query_id", "id", "score", "w")
        bound = first.join(_likest(first, held), ["query_id", "id"], "left").groupBy("query_id").agg(F.max(value).alias("bound"))
        left = kept(f"left{i}", known.join(bound, "query_id").where(F.col("mmr") >= F.col("bound") - NEAR).select("query_id", "id", "score", "w"))
    rows = left.join(_likest(left, held), ["query_id", "id"], "left").withColumn("mmr", value)
    return rows.withColumn("k", F.row_number().over(by.orderBy(F.desc("mmr"), "id"))).where("k = 1").select("query_id", "id", "mmr")


def unique_turns(units: DataFrame, turns: DataFrame) -> DataFrame:
    """Each turn of ranked units (query_id, rank, session_id, source_turn_ids) once, under the first unit that holds it."""
    each = units.select("query_id", "rank", "session_id", F.explode("source_turn_ids").alias("turn_id"))
    return each.groupBy("query_id", "session_id", "turn_id").agg(F.min("rank").alias("rank")).join(turns, ["session_id", "turn_id"])


def parent_facts(cards: DataFrame, caps: dict[str, int]) -> DataFrame:
    """One line for each distinct card that points to turns: its fields, each cut to its cap."""
    parts = [F.concat(F.lit(f"{name}="), F.substring(F.coalesce(F.col(name), F.lit("")), 1, cap)) for name, cap in caps.items()]
    return cards.where(F.size("source_turn_ids") > 0).dropDuplicates(["chunk_id"]).select("chunk_id", F.concat_ws(" | ", "chunk_id", *parts).alias("fact"))


def catalog(evidence: DataFrame) -> DataFrame:
    """evidence_id of each distinct turn of a query, in order of session and turn."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("session_id", "turn_id"))
    return evidence.dropDuplicates(["query_id", "session_id", "turn_id"]).withColumn("evidence_id", F.format_string("E%03d", nth))


def greedy_budget(units: DataFrame, budget: int, most: int) -> DataFrame:
    """Which units of each query fit: in rank order, one whose turns are all there already is skipped, and so is one over the budget.

    units: query_id, id, rank, tokens, turn_keys (array of strings). A query's units are its few hundred
    candidates, so a query is one group.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        kept, used = [], 0
        for r in rows.sort_values(["rank", "id"]).itertuples(index=False):
            if len(kept) >= most:
                break
            keys = set(r.turn_keys)
            if (kept and keys and keys <= seen) or used + r.tokens > budget:
                continue
            used += int(r.tokens)
            seen |= keys
            kept.append((r.query_id, r.id, len(kept) + 1, used))
        return pd.DataFrame(kept, columns=["query_id", "id", "position", "used_tokens"])

    return units.groupBy("query_id").applyInPandas(choose, "query_id long, id string, position int, used_tokens long")


def best_subset(units: DataFrame, budget: int, most: int, tries: int = 25_000) -> DataFrame:
    """The subset of a query's units that covers most turns within the budget, fewer tokens first, then better ranks.

    All subsets are tried while there are at most `tries`; beyond, units are taken greedily (proven_subset: the best at any number).
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"]).reset_index(drop=True)
        items = [(int(t), frozenset(k)) for t, k in zip(rows.tokens, rows.turn_keys, strict=True)]
        n, total = len(items), 0
        for size in range(1, min(most, n) + 1):
            total += comb(n, size)
        best: tuple = (0, 0, ())
        if total <= tries:
            for size in range(1, min(most, n) + 1):
                for picked in combinations(range(n), size):
                    tokens = sum(items[i][0] for i in picked)
                    if tokens <= budget:
                        key = (-len(frozenset().union(*(items[i][1] for i in picked))), tokens, picked)
                        best = min(best, key)
        else:
            taken: list[int] = []
            for i in range(n):
                if len(taken) < most and sum(items[j][0] for j in taken) + items[i][0] <= budget:
                    taken.append(i)
            best = (0, 0, tuple(taken))
        return pd.DataFrame([(rows.query_id[i], rows.id[i]) for i in best[2]], columns=["query_id", "id"])

    return units.groupBy("query_id").applyInPandas(choose, "query_id long, id string")


def proven_subset(units: DataFrame, budget: int, most: int) -> DataFrame:
    """query_id, id of the subset that best_subset looks for, proven best at any number of units.

    units: query_id, id, rank, tokens, turn_keys; a null counts as zero tokens or no turns, and of units with one rank
    the smaller id comes first. Branch and bound: units are taken in order of rank, and a branch is left once no
    completion of it can cover more turns, or as many with fewer tokens. An empty table gives no rows. A query's units,
    which are a pool of a search, meet in one task.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"]).reset_index(drop=True)
        keys = [[] if k is None else [x for x in k if x is not None] for k in rows.turn_keys]
        best = _proven([int(t) for t in rows.tokens.fillna(0)], _bits(keys), budget, most)
        return pd.DataFrame([(rows.query_id[i], rows.id[i]) for i in best], columns=["query_id", "id"])

    return units.groupBy("query_id").applyInPandas(choose, "query_id long, id string")


def _proven(tokens: list[int], sets: list[int], budget: int, most: int) -> tuple[int, ...]:
    """Places of the units of most coverage within the budget, then of fewest tokens, then the first in order of places.

    What a unit adds can only shrink as others are taken, so two relaxations bound a branch: the most that the open
    units could add if they overlapped nowhere and the last one could be cut, and the fewest tokens for which
    they could add what is wanted.
    """
    n = len(tokens)
    better = lambda j, i: sets[i] & ~sets[j] == 0 and (tokens[j] < tokens[i] or tokens[j] == tokens[i] > 0 and j < i)
    able = [i for i in range(n) if tokens[i] <= budget and not any(better(j, i) for j in range(n) if j != i)]
    # a first bound: what adds most for its tokens, again and again; equal results of the search still count as better
    seed: list[int] = []
    held = spent = 0
    while len(seed) < most:
        fits = [i for i in able if i not in seed and spent + tokens[i] <= budget and sets[i] & ~held]
        if not fits:
            break
        i = max(fits, key=lambda i: ((sets[i] & ~held).bit_count() / max(tokens[i], 1), -i))
        seed.append(i)
        held, spent = held | sets[i], spent + tokens[i]
    best: list = [held.bit_count(), spent + 0.5, tuple(sorted(seed))]

    def reach(adds: list[tuple[int, int]], room: float, slots: int) -> float:
        """The most that units (turns added, tokens) could add: the bound of tokens and that of slots, whichever is less."""
        total, left = 0.0, room
        for gain, cost in sorted(adds, key=lambda a: a[1] / a[0]):
            if cost > left:
                total += gain * left / cost
                break
            total, left = total + gain, left - cost
        return min(total, sum(sorted((a[0] for a in adds), reverse=True)[:slots]))

    def price(adds: list[tuple[int, int]], wanted: int) -> float:
        """The fewest tokens for which units could add what is wanted."""
        cost_of, left = 0.0, wanted
        for gain, cost in sorted(adds, key=lambda a: a[1] / a[0]):
            if gain >= left:
                return cost_of + cost * left / gain
            cost_of, left = cost_of + cost, left - gain
        return float("inf")

    def search(picked: tuple[int, ...], at: int, held: int, spent: int) -> None:
        covered = held.bit_count()
        if (-covered, spent) < (-best[0], best[1]):
            best[:] = [covered, spent, picked]
        if len(picked) == most:
            return
        for k in range(at, len(able)):
            open_units = able[k:]
            adds = [(g, tokens[i]) for i in open_units if spent + tokens[i] <= budget and (g := (sets[i] & ~held).bit_count())]
            could = covered + int(reach(adds, budget - spent, most - len(picked)) + 1e-9)
            union = held
            for i in open_units:
                union |= sets[i]
            could = min(could, union.bit_count())
            if could < best[0] or could == best[0] and (could == covered or spent + price(adds, best[0] - covered) >= best[1] - 1e-9):
                return  # what equals the best was met before it, in order of places
            i = able[k]
            if spent + tokens[i] <= budget:
                search((*picked, i), k + 1, held | sets[i], spent + tokens[i])

    search((), 0, 0, 0)
    return best[2]


def coverage_subset(units: DataFrame, budget: int, most: int, tries: int = 25_000) -> DataFrame:
    """The subset of a query's units that covers most, within the budget: query_id, id, position.

    units: query_id, id, rank, tokens, session_id, turn_ids (array of int), parent_turns (those turns that a parent card
    points to), card_ids (parent cards it touches), roles. Compared are, in order: parent turns, cards, turns, ends of
    sessions, roles; then fewer sessions and better ranks. Subsets that hold both ends of every session come first, and
    among them turns and unbroken runs from the start, to the end and anywhere count before the rest. All subsets are
    tried while there are at most `tries`; beyond, units are taken by rank while they fit. Of more than max(20, 4 * most)
    units, only the first so many are looked at. Both bounds belong to the rule that this function re-expresses; proven_subset has none.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"]).reset_index(drop=True).iloc[: max(20, 4 * most)]
        best = _covering(rows, budget, most) if sum(comb(len(rows), k) for k in range(1, min(most, len(rows)) + 1)) <= tries else _fitting(rows, budget, most)
        return pd.DataFrame([(rows.query_id[i], rows.id[i], n) for n, i in enumerate(best, 1)], columns=["query_id", "id", "position"])

    return units.groupBy("query_id").applyInPandas(choose, "query_id long, id string, position int")


def _fitting(rows: pd.DataFrame, budget: int, most: int) -> list[int]:
    taken: list[int] = []
    for i, tokens in enumerate(rows.tokens):
        if len(taken) < most and int(rows.tokens.iloc[taken].sum()) + tokens <= budget:
            taken.append(i)
    return taken


def _bits(values) -> list[int]:
    """Sets of values as bits of numbers, so that a union is an or."""
    place: dict = {}
    return [sum(1 << place.setdefault(v, len(place)) for v in set(own)) for own in values]


def _covering(rows: pd.DataFrame, budget: int, most: int) -> list[int]:
    n, sessions = len(rows), rows.session_id.tolist()
    places = [{(s, int(t)) for t in ids} for s, ids in zip(sessions, rows.turn_ids, strict=True)]
    spans = [(min(t for _, t in p), max(t for _, t in p)) if p else (1 << 31, -1) for p in places]
    ends: list[set] = [set() for _ in range(n)]
    for s in set(sessions):
        own = [i for i in range(n) if sessions[i] == s]
        ends[min(own, key=lambda i: (spans[i][0], i))].add((s, "start"))
        ends[max(own, key=lambda i: (spans[i][1], -i))].add((s, "end"))
    every = set().union(*ends)
    edge = {s: (min(spans[i][0] for i in range(n) if sessions[i] == s), max(spans[i][1] for i in range(n) if sessions[i] == s)) for s in set(sessions)}
    parent = _bits([{(s, int(t)) for t in ids} for s, ids in zip(sessions, rows.parent_turns, strict=True)])
    sets = [parent, _bits(rows.card_ids), _bits(places), _bits(ends), _bits(rows.roles), _bits([[s] for s in sessions])]
    tokens, ranks, all_ends = rows.tokens.tolist(), rows["rank"].tolist(), len(every)

    def runs(picked: tuple[int, ...]) -> tuple[int, int, int]:
        """Turns in the runs from the first turn, to the last, and in the longest run, summed over sessions."""
        out = [0, 0, 0]
        for s in {sessions[i] for i in picked}:
            low, high = edge[s]
            line = "".join("x" if any((s, t) in places[i] for i in picked) else " " for t in range(low, high + 1))
            for k, size in enumerate((len(line) - len(line.lstrip("x")), len(line) - len(line.rstrip("x")), max(map(len, line.split())))):
                out[k] += size
        return out[0], out[1], out[2]

    best: tuple = ()
    for size in range(1, min(most, n) + 1):
        for picked in combinations(range(n), size):
            if sum(tokens[i] for i in picked) > budget:
                continue
            held = [0] * 6
            for i in picked:
                held = [a | b[i] for a, b in zip(held, sets, strict=True)]
            parents, cards, turns, at_ends, roles, spread = (x.bit_count() for x in held)
            rest = (parents, cards, turns, at_ends, roles, -spread, -sum(ranks[i] for i in picked), tuple(-ranks[i] for i in picked))
            whole = at_ends == all_ends
            if whole:
                start, end, longest = runs(picked)
                rest = (turns, start, end, longest, *rest)
            best = max(best, (whole, rest, picked), key=lambda b: b[:2]) if best else (whole, rest, picked)
    return list(best[2]) if best else []


def fallback_context(windows: DataFrame, most: int = 5, budget: int = 4000) -> DataFrame:
    """query_id, context of the first windows of each query: turns once, in order, cut at twice the budget in characters.

    windows: query_id, rank, and turns as an array of struct session_id, turn_id, line.
    """
    each = windows.where(F.col("rank") <= most).select("query_id", F.explode("turns").alias("t"))
    held = each.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("t.session_id", "t.turn_id", "t.line"))).alias("t"))
    return held.select("query_id", F.substring(F.array_join(F.transform("t", lambda t: t["line"]), "\n"), 1, 2 * budget).alias("context"))
