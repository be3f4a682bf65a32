"""From raw rows to sessions and turns: run-length turns, pivots, subject paths, fusion, quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx


def turn_runs(messages: DataFrame, session: str, order: list[str], speaker: str, first: int = 1) -> DataFrame:
    """Adds turn_id: consecutive rows of one speaker in a session share it, counting from first.

    Gaps and islands on one partitioning by session: a change of speaker starts a turn.
    """
    by = Window.partitionBy(session).orderBy(*order)
    changed = F.coalesce((F.col(speaker) != F.lag(speaker).over(by)).cast("int"), F.lit(0))
    return messages.withColumn("_changed", changed).withColumn("turn_id", (F.sum("_changed").over(by) + first).cast("int")).drop("_changed")


def compress_turns(messages: DataFrame) -> DataFrame:
    """Turns of raw dialogue rows (InterventionId, MessageSequence, IsTutor, MessageString, TalkMovePrediction).

    Messages of a run are joined by spaces, redacted and squeezed; talk moves keep their first order. The raw
    messages of a turn stay as an array.
    """
    rows = messages.select(
        F.col("InterventionId").alias("session_id"), F.col("MessageSequence").alias("seq"), (F.col("IsTutor") == 1).alias("is_tutor"),
        F.trim(F.coalesce("MessageString", F.lit(""))).alias("message"), F.trim("TalkMovePrediction").alias("move"),
    )
    runs = turn_runs(rows, "session_id", ["seq"], "is_tutor")
    whole = runs.groupBy("session_id", "turn_id", "is_tutor").agg(F.sort_array(F.collect_list(F.struct("seq", "message", "move"))).alias("parts"))
    moves = F.filter(F.transform("parts", lambda p: p["move"]), lambda m: m.isNotNull() & (m != "") & ~m.isin(*tx.NO_MOVE))
    raw = F.transform("parts", lambda p: p["message"])
    out = whole.select("session_id", "turn_id", "is_tutor", raw.alias("raw_messages"), tx.clean(F.array_join(raw, " ")).alias("c"), F.array_distinct(moves).alias("talk_moves"))
    return out.select("session_id", "turn_id", F.when(F.col("is_tutor"), "tutor").otherwise("student").alias("speaker"), "is_tutor", "raw_messages", F.col("c.text").alias("text"), "talk_moves", F.col("c.is_noise").alias("is_noise"))


def session_counts(turns: DataFrame) -> DataFrame:
    """Turn counts of each session and whether it is valid tutoring: two turns at least and both roles speak."""
    out = turns.groupBy("session_id").agg(
        F.count("*").alias("total_turns"), F.count_if(F.col("speaker") == "student").alias("student_turn_count"), F.count_if(F.col("speaker") == "tutor").alias("tutor_turn_count")
    )
    return out.withColumn("has_valid_tutoring", quality_gate())


def quality_gate() -> Column:
    return (F.col("total_turns") >= 2) & (F.col("student_turn_count") > 0) & (F.col("tutor_turn_count") > 0)


def pivot_questions(metadata: DataFrame) -> DataFrame:
    """question_id, question_text, options, images from attribute rows (QuestionId_DQ, Text, Sequence, Label).

    Stem parts are joined by line breaks in order of Sequence; of repeated options the last counts.
    """
    rows = metadata.select(F.col("QuestionId_DQ").alias("question_id"), F.coalesce(F.col("Sequence"), F.lit(0)).alias("seq"), F.trim(F.coalesce("Text", F.lit(""))).alias("text"), F.trim("Label").alias("label"))
    letter = F.regexp_extract("label", "^Answer ([A-D]) Text$", 1)
    image = F.when(F.col("label") == "Question Image", F.lit("Question")).when(F.col("label").contains("Image"), F.trim(F.replace(F.replace("label", F.lit("Answer "), F.lit("")), F.lit(" Image"), F.lit(""))))
    rows = rows.withColumn("letter", F.when(letter != "", letter)).withColumn("image", image)
    stem = F.collect_list(F.when((F.col("label") == "Question Text") & (F.col("text") != ""), F.struct("seq", "text")))
    by_question = rows.groupBy("question_id").agg(
        F.array_join(F.transform(F.sort_array(stem), lambda x: x["text"]), "\n").alias("question_text"),
        *[F.max_by("text", F.when(F.col("letter") == k, F.col("seq"))).alias(k) for k in "ABCD"],
        F.sort_array(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("image", "seq", "text")))).alias("shots"),
    )
    options = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in "ABCD"]), lambda e: e["value"].isNotNull()))
    last = F.filter(F.col("shots"), lambda x: ~F.exists(F.col("shots"), lambda y: (y["image"] == x["image"]) & (y["seq"] > x["seq"])))
    images = F.map_from_entries(F.array_distinct(F.transform(last, lambda x: F.struct(x["image"].alias("key"), x["text"].alias("value")))))
    return by_question.select("question_id", "question_text", options.alias("options"), images.alias("images"))


def subject_paths(subjects: DataFrame, key: str = "InterventionId") -> DataFrame:
    """Paths of each session's subject tree: by third level, else second, else first; and the names of each level.

    A parent that isn't there is General. Order is that of _row, the file's order, if there, else of SubjectId.
    """
    order = "_row" if "_row" in subjects.columns else "SubjectId"
    rows = subjects.select(F.col(key).alias("k"), F.col("SubjectId").alias("id"), F.coalesce("ParentSubjectId", F.lit(0)).alias("parent"), F.trim("SubjectName").alias("name"), F.col("SubjectLevel").alias("level"), F.col(order).alias("at"))
    one, two, three = (rows.where(F.col("level") == n) for n in (1, 2, 3))
    top = one.select("k", F.col("id").alias("top_id"), F.col("name").alias("top"))
    mid = two.select("k", F.col("id").alias("mid_id"), F.col("parent").alias("mid_parent"), F.col("name").alias("mid"))
    general = F.coalesce(F.col("top"), F.lit("General"))
    deep = three.join(mid, (three["k"] == mid["k"]) & (three["parent"] == mid["mid_id"]), "left").select(three["k"], "at", "name", "mid", F.coalesce("mid_parent", "parent").alias("up"))
    deep = deep.join(top, (deep["k"] == top["k"]) & (deep["up"] == top["top_id"]), "left").select(deep["k"], "at", F.concat_ws(" > ", general, "mid", "name").alias("path"), F.lit(3).alias("depth"))
    second = two.join(top, (two["k"] == top["k"]) & (two["parent"] == top["top_id"]), "left").select(two["k"], "at", F.concat_ws(" > ", general, "name").alias("path"), F.lit(2).alias("depth"))
    first = one.select("k", "at", F.col("name").alias("path"), F.lit(1).alias("depth"))
    found = deep.unionByName(second).unionByName(first).groupBy("k").agg(F.max("depth").alias("best"), F.sort_array(F.collect_list(F.struct("depth", "at", "path"))).alias("all"))
    paths = F.array_distinct(F.transform(F.filter("all", lambda p: p["depth"] == F.col("best")), lambda p: p["path"]))
    names = rows.groupBy("k").agg(*[F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == n, F.struct("at", "name")))), lambda x: x["name"])).alias(a) for n, a in ((1, "subjects"), (2, "topics"), (3, "subtopics"))])
    return found.join(names, "k").select(F.col("k").alias(key), paths.alias("paths"), "subjects", "topics", "subtopics")


def fuse(dialogues: DataFrame, subjects: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sessions: header, question, subject path and counts, driven by the dialogues; a missing side is empty.

    Each side is aggregated by its key first, so the joins are one row to one.
    """
    turns = compress_turns(dialogues)
    # the question and tutor of a session are those of its first row in file order, if known, else of its first message
    order = "_row" if "_row" in dialogues.columns else "MessageSequence"
    tutor = "TutorId" if "TutorId" in dialogues.columns else "UserId"
    head = dialogues.groupBy(F.col("InterventionId").alias("session_id")).agg(F.min_by("QuestionId_DQ", order).alias("question_id"), F.min_by(tutor, order).alias("tutor_id"))
    paths = subject_paths(subjects).select(F.col("InterventionId").alias("session_id"), F.array_join("paths", " | ").alias("subject_path"))
    return head.join(session_counts(turns), "session_id", "left").join(paths, "session_id", "left").join(pivot_questions(metadata), "question_id", "left")


def dataset_statistics(sessions: DataFrame, measure: str) -> DataFrame:
    """n, mean, quartiles, least and most of a measure."""
    c = F.col(measure)
    return sessions.agg(F.count("*").alias("n"), F.sum(c).cast("long").alias("total"), F.avg(c).alias("mean"), F.percentile(c, 0.25).alias("p25"), F.percentile(c, 0.5).alias("median"), F.percentile(c, 0.75).alias("p75"), F.min(c).alias("least"), F.max(c).alias("most"))


def top_values(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k commonest values and their counts, ties by value."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)
