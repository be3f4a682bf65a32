"""Evidence for one question out of its best cards: parents of one session, its windows, the window that answers, what may be cited.

All questions of a table are answered in one job; a question's rows are its few cards and one session's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from . import retrieval as rt, windows as ws

# Words by which a question asks for both roles, for the tutor first, or for a kind of window.
BOTH_ROLES = ("导师如何", "导师怎么", "tutor", "teacher")
TUTOR_FIRST = ("导师", "老师", "tutor", "teacher")
INTERVENTION, REASONING, REVIEW = ("干预", "intervention"), ("推理过程",), ("回顾",)
VERBATIM = ("原声", "课堂证据", "实录", "课堂原话")
#: How a turn begins that says nothing yet, and how long one is that says something.
OPENING, TELLING = r"(?i)^(hi|hello|hey|good|how are you|i'?m great|im great)(?![0-9A-Za-z_])", 12
#: Turns and step of a window, parents of a question, cards whose turns may be cited, turns of each.
SIZE, STEP, PARENTS, CITING, CITED_TURNS = 7, 3, 5, 2, 7
#: Sections of the prompt.
SECTIONS = ("【学生错因卡】", "【导师策略卡】", "【7轮课堂上下文】")


def _asks(words: tuple[str, ...], routed: bool) -> Column:
    return rt._names(F.col("query"), words) if routed else F.lit(False)


def parents(cards: DataFrame, queries: DataFrame, limit: int = PARENTS, routed: bool = True) -> DataFrame:
    """Cards of a query's one session, with parent_rank.

    cards: query_id, position, chunk_id, card_type, session_id and more. The session is that of the first card; a
    question for both roles takes the first session that has cards of both, and then both kinds are parents. Not routed,
    a question is a text to find, such as a student's own words, and what it happens to name asks for nothing.
    """
    q = queries.select("query_id", _asks(BOTH_ROLES, routed).alias("both"), _asks(TUTOR_FIRST, routed).alias("lead"))
    query, session = Window.partitionBy("query_id"), Window.partitionBy("query_id", "session_id")
    rows = cards.join(q, "query_id").withColumn("pair", F.col("both") & (F.size(F.collect_set("card_type").over(session)) == 2))
    here = F.struct("position", "session_id", "card_type")
    rows = rows.withColumn("first", F.min(here).over(query)).withColumn("paired", F.min(F.when(F.col("pair"), here)).over(query))
    home = F.coalesce(F.col("paired.session_id"), F.col("first.session_id"))
    kept = rows.where((F.col("session_id") == home) & (F.col("both") | (F.col("card_type") == F.col("first.card_type"))))
    order = F.when(F.col("lead") & (F.col("card_type") == "TUTOR_STRATEGY"), 0).when(F.col("lead"), 1).otherwise(0)
    nth = F.row_number().over(query.orderBy(order, "position"))
    return kept.withColumn("parent_rank", nth).where(F.col("parent_rank") <= limit).drop("both", "lead", "pair", "first", "paired", "position")


def window_pool(chosen: DataFrame, queries: DataFrame, turns: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """query_id, session_id, start, first_turn, last_turn, ids, turns, numeric, score, rank of the parents' windows.

    A window's score is the words it shares with the query, ten for each number, two for each turn of the first parent.
    """
    home = chosen.groupBy("query_id", "session_id").agg(F.min_by("source_turn_ids", "parent_rank").alias("anchors"))
    placed = ws._positions(turns.join(home.select("session_id").distinct(), "session_id", "left_semi"))
    starts = F.filter(ws.window_starts(F.col("n"), size, step, False), lambda s: (F.col("pos") >= s) & (F.col("pos") < s + size))
    turn = F.struct("turn_id", "speaker", "text")
    held = placed.withColumn("start", F.explode(starts)).groupBy("session_id", "start").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    both = held.join(home, "session_id").join(queries.select("query_id", rt._long_words(F.col("query")).alias("words"), tx.signatures(F.col("query")).alias("numbers")), "query_id")
    ids, text = F.transform("turns", lambda t: t["turn_id"]), F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))), " ")
    both = both.select("*", ids.alias("ids"), rt._long_words(text).alias("own"), F.regexp_replace(text, r"\D", "").alias("digits"))
    hits = F.size(F.filter("numbers", lambda x: F.contains(F.col("digits"), x)))
    score = F.size(F.array_intersect("words", "own")) + 10 * hits + 2 * F.size(F.array_intersect("ids", "anchors"))
    rows = both.select("query_id", "session_id", "start", F.element_at("ids", 1).alias("first_turn"), F.element_at("ids", -1).alias("last_turn"), "ids", "turns", (hits > 0).alias("numeric"), score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "session_id", "first_turn")))


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("turn_id")))


def anchors(chosen: DataFrame, queries: DataFrame, turns: DataFrame, routed: bool = True) -> DataFrame:
    """query_id, pointers, way, preferred, anchor: which turn a question's window should hold, by the way it asks.

    preferred is the first pointer that tells something. An intervention (asked of a session with both kinds of
    cards) looks for the numbers of a strategy's key question; reasoning for the last pointer before the first number
    of the question, or before the tutor's first number; verbatim for a quote of the first card that holds a number.
    """
    cards = chosen.withColumns({name: F.lit(None).cast(kind) for name, kind in (("question_text", "string"), ("key_aha_question", "string"), ("quotes", "array<string>")) if name not in chosen.columns})
    by = cards.groupBy("query_id", "session_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_turn_ids")))).alias("pointers"), (F.count_distinct("card_type") == 2).alias("paired"),
        F.min_by("question_text", "parent_rank").alias("question"), F.min_by(F.coalesce("quotes", F.array().cast("array<string>")), "parent_rank").alias("quotes"),
        F.sort_array(F.collect_list(F.when(F.col("card_type") == "TUTOR_STRATEGY", F.struct("parent_rank", F.coalesce("key_aha_question", F.lit("")).alias("text"))))).alias("strategies"),
    )
    asks = lambda words: _asks(words, routed)
    rows = by.join(queries, "query_id")
    rows = rows.withColumn("way", F.when(F.col("paired") & asks(INTERVENTION), "intervention").when(asks(REASONING), "reasoning").when(asks(VERBATIM), "verbatim").otherwise("anchor"))
    rows = rows.withColumn("numbers", tx.signatures(F.coalesce("question", F.lit("")))).drop("query")
    t = turns.select("session_id", "turn_id", F.coalesce("text", F.lit("")).alias("text"), "speaker", F.coalesce("is_noise", F.lit(False)).alias("noise") if "is_noise" in turns.columns else F.lit(False).alias("noise"))
    each = rows.join(t, "session_id").withColumn("pointer", F.array_contains("pointers", F.col("turn_id"))).withColumn("own", tx.signatures(F.col("text")))
    tells = ~F.col("noise") & (F.length(F.trim("text")) >= TELLING) & ~F.rlike(F.trim("text"), F.lit(OPENING))
    alike = lambda c: F.size(F.array_intersect(c, "own")) > 0
    # the first strategy, and the first quote, that a pointer answers
    strategy = F.array_min(F.transform(F.filter("strategies", lambda s: F.size(F.array_intersect(tx.signatures(s["text"]), F.col("own"))) > 0), lambda s: s["parent_rank"]))
    quote = F.array_min(F.filter(F.transform("quotes", lambda x, i: F.when((F.size(tx.signatures(x)) > 0) & (tx.compact(x) == tx.compact(F.col("text"))), i)), lambda i: i.isNotNull()))
    each = each.withColumn("strategy", F.when(F.col("pointer"), strategy)).withColumn("quote", F.when(F.col("pointer"), quote))
    found = each.groupBy("query_id", "session_id", "pointers", "way").agg(
        _first(F.col("pointer") & tells).alias("preferred"), F.coalesce(_first(F.col("pointer") & alike("numbers")), _first((F.col("speaker") == "tutor") & (F.size("own") > 0))).alias("bound"),
        F.min(F.when(F.col("strategy").isNotNull(), F.struct("strategy", "turn_id")))["turn_id"].alias("strategic"), F.min(F.when(F.col("quote").isNotNull(), F.struct("quote", "turn_id")))["turn_id"].alias("quoted"),
    )
    before = F.array_max(F.filter("pointers", lambda p: F.col("bound").isNull() | (p < F.col("bound"))))
    anchor = F.when(F.col("way") == "intervention", F.col("strategic")).when(F.col("way") == "reasoning", F.coalesce(before, "preferred")).when(F.col("way") == "verbatim", F.coalesce("quoted", "preferred")).otherwise(F.col("preferred"))
    return found.select("query_id", "pointers", "way", "preferred", anchor.alias("anchor"))


def choose_window(pool: DataFrame, marks: DataFrame, queries: DataFrame, routed: bool = True) -> DataFrame:
    """The one window of each query, with the columns of the pool.

    Windows that hold a number of the query come first, unless the way of asking forbids it; then those with the
    anchor; then those with the preferred turn; else the best ranked. Of several the earliest is it. An intervention
    without a strategy's number takes the best window that holds most pointers.
    """
    by = Window.partitionBy("query_id")
    plain = ~_asks((*REVIEW, *REASONING, *INTERVENTION), routed)
    rows = pool.join(marks, "query_id").join(queries.select("query_id", plain.alias("plain")), "query_id")
    best = F.row_number().over(by.orderBy(F.desc("score"), F.desc(F.size(F.array_intersect("ids", "pointers"))), "first_turn")) == 1
    holds = lambda c: F.coalesce(F.array_contains("ids", F.col(c)), F.lit(False))
    rows = rows.withColumn("held", F.when((F.col("way") == "intervention") & F.col("anchor").isNull(), best).otherwise(holds("anchor"))).withColumn("likely", holds("preferred"))
    some = lambda c: F.bool_or(c).over(by)
    member = F.when(F.col("plain") & some(F.col("numeric")), F.col("numeric")).when(some(F.col("held")), F.col("held")).otherwise(F.col("likely"))
    rows = rows.withColumn("member", member)
    order = [F.desc("member"), F.when(some(F.col("member")), F.col("first_turn")).otherwise(F.col("rank"))]
    return rows.withColumn("nth", F.row_number().over(by.orderBy(*order))).where("nth = 1").select(*pool.columns)


def evidence(cards: DataFrame, queries: DataFrame, turns: DataFrame, events: DataFrame, routed: bool = True) -> DataFrame:
    """query_id, session_id, parent_ids, window_id, source_turn_ids, citations, prompt, status of each query with cards.

    events: source_card_id, source_session_id, source_turn_ids of the graph's event nodes. The first two parents that
    have an event may be cited by their first seven turns of their own role, as far as the window holds them; without
    such turns a query has NO_EVIDENCE and no window.
    """
    chosen = parents(cards, queries, routed=routed)
    role = F.when(F.col("card_type") == "TUTOR_STRATEGY", "tutor").otherwise("student")
    own = events.select(F.col("source_card_id").alias("chunk_id"), F.col("source_session_id").alias("session_id"), F.explode("source_turn_ids").alias("turn_id")).distinct()
    points = chosen.where(F.col("parent_rank") <= CITING).select("query_id", "chunk_id", "session_id", role.alias("speaker")).join(own, ["chunk_id", "session_id"])
    said = points.join(turns.select("session_id", "turn_id", "speaker", "text"), ["session_id", "turn_id", "speaker"])
    may = said.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("turn_id"))).where(F.col("n") <= CITED_TURNS)
    cited = may.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("turn_id", "speaker", "text"))).alias("may"))
    # an intervention is about the question, so its words count as asked
    first = chosen.groupBy("query_id").agg(F.min_by("question_text", "parent_rank").alias("question"))
    asked = queries.join(first, "query_id").select("query_id", F.when(_asks(INTERVENTION, routed), F.concat_ws(" ", "query", "question")).otherwise(F.col("query")).alias("query"))
    window = choose_window(window_pool(chosen, asked, turns), anchors(chosen, queries, turns, routed), asked, routed)
    title = F.coalesce("misconception_name", "pedagogical_goal", F.lit("")) if {"misconception_name", "pedagogical_goal"} <= set(chosen.columns) else F.lit("")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("parent_rank", F.concat(F.col("chunk_id"), F.lit(": "), title).alias("line")))), lambda x: x["line"]), "\n")
    heads = [F.when(F.bool_or(F.col("card_type") == kind), F.lit(name)) for kind, name in (("MISCONCEPTION", SECTIONS[0]), ("TUTOR_STRATEGY", SECTIONS[1]))]
    top = chosen.groupBy("query_id").agg(F.concat_ws("\n", *heads, lines).alias("head"), F.transform(F.sort_array(F.collect_list(F.struct("parent_rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("parent_ids"))
    name = F.concat(F.lit("session_"), F.col("session_id").cast("string"), F.lit("_win_"), F.col("first_turn").cast("string"), F.lit("_"), F.col("last_turn").cast("string"))
    spoken = F.transform("turns", lambda t: F.concat(F.lit("[Turn "), t["turn_id"].cast("string"), F.lit("] ["), t["speaker"], F.lit("] "), F.coalesce(t["text"], F.lit(""))))
    rows = top.join(window.withColumn("window_id", name).join(cited, "query_id"), "query_id", "left")
    prompt = F.concat_ws("\n", "head", F.lit(SECTIONS[2]), F.concat(F.lit("【Window "), F.col("window_id"), F.lit("】")), F.array_join(spoken, "\n"))
    good = F.col("may").isNotNull()
    return rows.select(
        "query_id", "session_id", "parent_ids", "window_id", F.col("ids").alias("source_turn_ids"), F.filter("may", lambda c: F.array_contains("ids", c["turn_id"])).alias("citations"),
        F.when(good, prompt).alias("prompt"), F.when(good, "SUCCESS").otherwise("NO_EVIDENCE").alias("status"),
    )
