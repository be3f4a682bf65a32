"""Windows over a session's turns, their anchors, and runs of covered turns.

A window is made from a turn's own position: each turn knows which windows hold it, so turns are exploded
into their few windows and grouped; no range join and no pass over pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx


def _positions(turns: DataFrame) -> DataFrame:
    """Adds pos (from 0) and n of each session; sessions are expected without gaps in meaning, ids may have gaps."""
    by = Window.partitionBy("session_id")
    return turns.withColumn("pos", F.row_number().over(by.orderBy("turn_id")) - 1).withColumn("n", F.count("*").over(by))


def window_starts(n: Column, size: int, step: int, stop_at_end: bool) -> Column:
    """Where windows of n turns start: with the stop, none after the first that reaches the end."""
    last = F.when(F.lit(stop_at_end), F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int") * step).otherwise(n - 1)
    return F.sequence(F.lit(0), last.cast("int"), F.lit(step))


def gap_free(n: Column, size: int, step: int) -> Column:
    """gap_free_starts as an array column, for a column of numbers of turns."""
    last = F.floor((n - 1) / step).cast("int")
    fill = lambda i: F.sequence(i * step, F.greatest(i * step, F.least((i + 1) * step, n) - 1), F.lit(max(size, 1))) if step > size else F.array(i * step)
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fill))).otherwise(F.array().cast("array<int>"))


def gap_free_starts(n: int, size: int, step: int) -> list[int]:
    """Starts that leave no position uncovered even if steps are longer than windows: further starts fill the gaps."""
    starts, covered, at = [], 0, 0
    while covered < n:
        while covered < at:
            starts.append(covered)
            covered += size
        if at < n:
            starts.append(at)
        covered = max(covered, at + size)
        at += step
    return starts


def _line(t: Column) -> Column:
    return F.concat(F.lit("[Turn "), t["turn_id"].cast("string"), F.lit("] "), t["speaker"], F.lit(": "), F.coalesce(t["text"], F.lit("")))


def sliding_windows(turns: DataFrame, size: int = 6, step: int = 3, stop_at_end: bool = True, body: str = "text", line: Callable[[Column], Column] = _line) -> DataFrame:
    """session_id, start, first_turn, last_turn, source_turn_ids, content of each window.

    Content has a line for each turn, speaker first. With the stop a window that reaches the end is the last.
    """
    placed = _positions(turns)
    starts = F.filter(window_starts(F.col("n"), size, step, stop_at_end), lambda s: (F.col("pos") >= s) & (F.col("pos") < s + size))
    each = placed.withColumn("start", F.explode(starts))
    held = each.groupBy("session_id", "start").agg(F.sort_array(F.collect_list(F.struct("turn_id", "speaker", F.col(body).alias("text")))).alias("t"))
    return held.select(
        "session_id", "start", F.element_at("t", 1)["turn_id"].alias("first_turn"), F.element_at("t", -1)["turn_id"].alias("last_turn"),
        F.transform("t", lambda t: t["turn_id"]).alias("source_turn_ids"), F.array_join(F.transform("t", line), "\n").alias("content"),
    )


def window_chunks(turns: DataFrame, sessions: DataFrame, size: int = 6, step: int = 3) -> DataFrame:
    """Windows as chunks: id, header of subject, and an estimate of tokens."""
    made = sliding_windows(turns, size, step).join(sessions.select("session_id", "question_id", "subject_path"), "session_id")
    content = F.concat(F.lit("Subject: "), F.coalesce("subject_path", F.lit("")), F.lit("\n"), F.col("content"))
    return made.select(F.concat(F.lit("session_"), F.col("session_id").cast("string"), F.lit("_win_"), F.col("first_turn").cast("string"), F.lit("_"), F.col("last_turn").cast("string")).alias("chunk_id"), "session_id", "question_id", "subject_path", "first_turn", "last_turn", content.alias("content"), tx.token_estimate_words(content).alias("token_count"), "source_turn_ids")


# What experimental chunkers write around dialogue.
_HEADER = ("[考纲考点]: ", "\n[题目题干]: ", "\n[选项分布]: ", "\n--- [师生互动实录] ---\n")
_PARENT = ("=== PARENT SESSION (", ") ===\n[考点]: ", "\n[题干]: ", "\n[选项]: ", "\n--- 完整辅导实录 ---\n")
_CARD = ("【学生认知错因卡】\n[考点路径]: ", "\n[原题干]: ", "\n[备选选项]: ", "\n[学生疑惑与典型错解原声]:\n")
_STRATEGY = ("【名师破局引导策略卡】\n[考点路径]: ", "\n[原题干]: ", "\n[核心启发式提问与分步脚手架实录]:\n")
QUOTES, PROMPT_CHARS = 3, 15


def _spoken(t: Column) -> Column:
    return F.concat(F.lit("[Turn "), t["turn_id"].cast("string"), F.lit(" - "), t["speaker"], F.lit("]: "), F.coalesce(t["text"], F.lit("")))


def _about(sessions: DataFrame) -> DataFrame:
    """session_id, path, stem, options of each session; options is an array of label and text, or missing."""
    options = F.array_join(F.transform("options", lambda o: F.concat_ws(": ", o["label"], o["text"])), ", ") if "options" in sessions.columns else F.lit("")
    return sessions.select("session_id", F.coalesce("subject_path", F.lit("Unknown Subject")).alias("path"), F.coalesce("question_text", F.lit("")).alias("stem"), F.coalesce(options, F.lit("")).alias("options"))


def _around(parts: tuple[str, ...], *values: Column) -> Column:
    return F.concat(*[x for pair in zip((F.lit(p) for p in parts), values, strict=True) for x in pair])


def _chunk_id(kind: str) -> Column:
    return F.concat(F.col("session_id").cast("string"), F.lit(f"_{kind}_"), F.col("first_turn").cast("string"), F.lit("_"), F.col("last_turn").cast("string"))


def header_chunks(turns: DataFrame, sessions: DataFrame, size: int = 2, step: int = 2) -> DataFrame:
    """chunk_id, session_id, source_turn_ids, content: pairs of turns under a header of subject, question and options."""
    made = sliding_windows(turns, size, step, line=_spoken).join(_about(sessions), "session_id")
    options = F.when(F.col("options") == "", "No Options").otherwise(F.col("options"))
    return made.select(_chunk_id("hi").alias("chunk_id"), "session_id", "source_turn_ids", _around(_HEADER, F.col("path"), F.col("stem"), options, F.col("content")).alias("content"))


def parent_child_chunks(turns: DataFrame, sessions: DataFrame, size: int = 2, step: int = 2) -> tuple[DataFrame, DataFrame]:
    """Children (chunk_id, parent_id, source_turn_ids, content) to search, and each session once as parent (parent_id, content) to read."""
    about = _about(sessions)
    parent_id = F.concat(F.lit("parent_"), F.col("session_id").cast("string")).alias("parent_id")
    bare = sliding_windows(turns, size, step, line=lambda t: F.concat(F.lit("["), t["speaker"], F.lit("]: "), F.coalesce(t["text"], F.lit("")))).join(about, "session_id")
    children = bare.select(_chunk_id("child").alias("chunk_id"), parent_id, "source_turn_ids", F.concat(F.lit("["), F.col("path"), F.lit("] "), F.col("content")).alias("content"))
    whole = turns.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_id", "speaker", "text"))), _spoken), "\n").alias("spoken")).join(about, "session_id")
    return children, whole.select(parent_id, _around(_PARENT, F.col("session_id").cast("string"), F.col("path"), F.col("stem"), F.col("options"), F.col("spoken")).alias("content"))


def distilled_chunks(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Two cards a session: the first student quotes, and the tutor's longer prompts with their moves; noise is left out.

    Both are summaries: three quotes, and prompts of more than fifteen characters, are the feature.
    """
    moves = F.array_join("talk_moves", ",") if "talk_moves" in turns.columns else F.lit("")
    spoken = turns.where(~F.coalesce("is_noise", F.lit(False))).withColumn("moves", moves)
    said = F.concat(F.lit("Turn "), F.col("turn_id").cast("string"), F.when(F.col("is_tutor"), F.concat(F.lit(" ("), F.col("moves"), F.lit(")"))).otherwise(F.lit("")), F.lit(': "'), F.coalesce("text", F.lit("")), F.lit('"'))
    by = spoken.groupBy("session_id", "is_tutor").agg(F.sort_array(F.collect_list(F.struct("turn_id", said.alias("said"), (F.length("text") > PROMPT_CHARS).alias("long")))).alias("t"))
    both = sessions.select("session_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_tutor")).join(turns.select("session_id").distinct(), "session_id", "left_semi").join(by, ["session_id", "is_tutor"], "left").join(_about(sessions), "session_id")
    told = F.coalesce("t", F.array().cast("array<struct<turn_id:int,said:string,long:boolean>>"))
    lines = lambda xs: F.array_join(F.transform(xs, lambda x: x["said"]), "\n")
    card = _around(_CARD, F.col("path"), F.col("stem"), F.col("options"), lines(F.slice(told, F.lit(1), F.lit(QUOTES))))
    strategy = _around(_STRATEGY, F.col("path"), F.col("stem"), lines(F.filter(told, lambda x: x["long"])))
    name = F.concat(F.col("session_id").cast("string"), F.when(F.col("is_tutor"), "_distilled_strategy").otherwise("_distilled_misconception"))
    return both.select(name.alias("chunk_id"), "session_id", F.transform(told, lambda x: x["turn_id"]).alias("source_turn_ids"), F.when(F.col("is_tutor"), strategy).otherwise(card).alias("content"))


def anchored_windows(windows: DataFrame, anchors: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """Windows of a session that hold an anchor's turn, or any window of a session in complete, with parent_ids.

    anchors: session_id, parent_id, source_turn_ids. The overlap of turn lists is an equi-join on the session
    and the turn.
    """
    parts = windows.select("session_id", "start", F.explode("source_turn_ids").alias("turn_id"))
    points = anchors.select("session_id", "parent_id", F.explode("source_turn_ids").alias("turn_id"))
    hit = parts.join(points, ["session_id", "turn_id"]).groupBy("session_id", "start").agg(F.sort_array(F.collect_set("parent_id")).alias("parent_ids"))
    if complete is None:
        return windows.join(hit, ["session_id", "start"])
    whole = complete.select("session_id", F.lit(True).alias("completes")).distinct()
    out = windows.join(hit, ["session_id", "start"], "left").join(whole, "session_id", "left")
    return out.where(F.col("parent_ids").isNotNull() | F.col("completes")).withColumn("parent_ids", F.coalesce("parent_ids", F.array().cast("array<string>"))).withColumn("completes", F.coalesce("completes", F.lit(False)))


def coverage(windows: DataFrame) -> DataFrame:
    """session_id, turn_id that any window covers."""
    return windows.select("session_id", F.explode("source_turn_ids").alias("turn_id")).distinct()


def runs(covered: DataFrame) -> DataFrame:
    """session_id, run_start, run_length of contiguous covered turns: ids minus their rank are equal within a run."""
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id"))
    return covered.withColumn("island", F.col("turn_id") - nth).groupBy("session_id", "island").agg(F.min("turn_id").alias("run_start"), F.count("*").alias("run_length")).drop("island")


def run_shape(covered: DataFrame, sessions: DataFrame) -> DataFrame:
    """Longest run, and the runs at the first and the last of total_turns turns; none is 0."""
    r = runs(covered).join(sessions.select("session_id", "total_turns"), "session_id")
    ends = F.col("run_start") + F.col("run_length") - 1
    return r.groupBy("session_id").agg(F.max("run_length").alias("longest"), F.coalesce(F.max(F.when(F.col("run_start") == 1, F.col("run_length"))), F.lit(0)).alias("prefix"), F.coalesce(F.max(F.when(ends == F.col("total_turns"), F.col("run_length"))), F.lit(0)).alias("suffix"))


def evidence_units(turns: DataFrame, cards: DataFrame, size: int = 7, step: int = 3) -> DataFrame:
    """Windows of the sessions that cards belong to, one for each place, with the ids of all its cards."""
    ids = cards.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("card_ids"))
    made = sliding_windows(turns.join(ids.select("session_id"), "session_id", "left_semi"), size, step)
    unit = F.concat(F.lit("session_"), F.col("session_id").cast("string"), F.lit("_evidence_"), F.col("first_turn").cast("string"), F.lit("_"), F.col("last_turn").cast("string"))
    return made.join(ids, "session_id").select(unit.alias("chunk_id"), "session_id", "first_turn", "last_turn", "card_ids", "source_turn_ids")


def evidence_index(turns: DataFrame, size: int = 6, step: int = 3) -> DataFrame:
    """Per session the windows, turns by role, noise turns and a hash of the content; windows cover every turn."""
    if step > size:
        raise ValueError("steps longer than windows leave gaps: use gap_free_starts")
    w = sliding_windows(turns, size, step).groupBy("session_id").agg(F.count("*").alias("windows"))
    role = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("speaker") == r) & ~F.col("is_noise"), F.col("turn_id")))), lambda x: x.cast("string")), ",")
    noise = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_noise"), F.col("turn_id")))), lambda x: x.cast("string")), ",")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_id", "speaker", F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.concat_ws("\x1f", t["turn_id"].cast("string"), t["speaker"], t["text"])), "\x1e")
    by = turns.groupBy("session_id").agg(role("student").alias("student_turns"), role("tutor").alias("tutor_turns"), noise.alias("noise_turns"), F.sha2(lines, 256).alias("content_hash"))
    return by.join(w, "session_id")


def rebind_cards(cards: DataFrame, turns: DataFrame, role: str, quote: str) -> DataFrame:
    """Cards whose pointers are all of the role's turns that aren't noise; a quote that none of them holds becomes the first text."""
    own = turns.where((F.col("speaker") == role) & ~F.col("is_noise")).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn_id", "text"))).alias("t"))
    kept = F.exists("t", lambda t: tx.same_quote(F.col(quote), t["text"]))
    return cards.join(own, "session_id").select(*[c for c in cards.columns if c not in (quote, "source_turn_ids")], F.when(kept, F.col(quote)).otherwise(F.element_at("t", 1)["text"]).alias(quote), F.transform("t", lambda t: t["turn_id"]).alias("source_turn_ids"))


def chunks(strategy: str, windows: DataFrame, cards: DataFrame | None) -> tuple[DataFrame, str | None]:
    """Chunks (chunk_id, content) by strategy, and a warning: primary is cards, fallback windows, hybrid both.

    Without cards primary raises, and hybrid gives windows with the warning.
    """
    if strategy not in ("primary", "fallback", "hybrid"):
        raise ValueError(f"unknown strategy {strategy}")
    w = windows.select("chunk_id", "content")
    if strategy == "fallback":
        return w, None
    if cards is None:
        if strategy == "primary":
            raise ValueError("cards are needed")
        return w, "no cards: windows only"
    c = cards.select("chunk_id", "content")
    return (c, None) if strategy == "primary" else (c.unionByName(w), None)
