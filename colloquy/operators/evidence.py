"""Exact audits of citations and quotes, integrity of tables, and card validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx

FOUR = ["session_id", "turn_id", "speaker", "text"]


def audit_citations(citations: DataFrame, turns: DataFrame) -> DataFrame:
    """Citations with valid: whether session, turn, speaker and text are all exactly those of a turn."""
    known = turns.select(*FOUR).distinct().withColumn("valid", F.lit(True))
    return citations.join(known, FOUR, "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def citation_hit_rate(citations: DataFrame, turns: DataFrame) -> DataFrame:
    """n, hits, rate; no citations give no rate."""
    return audit_citations(citations, turns).agg(F.count("*").alias("n"), F.count_if("valid").alias("hits"), F.try_divide(F.count_if("valid").cast("double"), F.count("*").cast("double")).alias("rate"))


def evidence_catalog(evidence: DataFrame, case: str) -> DataFrame:
    """evidence_id of each distinct turn of a case in order of first sight (at); turns with two texts are conflicts."""
    first = evidence.groupBy(*dict.fromkeys((case, "session_id", "turn_id"))).agg(F.min("at").alias("at"), F.min_by("speaker", "at").alias("speaker"), F.min_by("text", "at").alias("text"), (F.count_distinct("speaker", "text") > 1).alias("conflict"))
    return first.withColumn("evidence_id", F.format_string("E%03d", F.row_number().over(Window.partitionBy(case).orderBy("at", "session_id", "turn_id"))))


def materialize_citations(cited: DataFrame, catalog: DataFrame) -> DataFrame:
    """evidence_id, status of cited ids: OK, UNKNOWN, DUPLICATE."""
    counted = cited.groupBy("evidence_id").agg(F.count("*").alias("times"))
    known = catalog.select("evidence_id", F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "UNKNOWN").when(F.col("times") > 1, "DUPLICATE").otherwise("OK")
    return counted.join(known, "evidence_id", "left").select("evidence_id", status.alias("status"))


def claim_coverage(claims: DataFrame) -> DataFrame:
    """claims (claim_id, evidence_ids, cited_ids): unclosed, the ids that aren't cited, and whether any evidence is there."""
    return claims.select("claim_id", F.size(F.array_except("evidence_ids", "cited_ids")).alias("unclosed"), (F.size("evidence_ids") > 0).alias("covered"))


def claim_violations(claims: DataFrame) -> DataFrame:
    """claim_id, reason: facts and inferences need evidence, inferences a qualification, ids are unique."""
    twice = F.count("*").over(Window.partitionBy("claim_id")) > 1
    reason = F.when(twice, "DUPLICATE_ID").when(F.col("kind").isin("fact", "inference") & (F.size("evidence_ids") == 0), "NO_EVIDENCE").when((F.col("kind") == "inference") & (F.coalesce(F.trim("qualification"), F.lit("")) == ""), "NO_QUALIFICATION")
    return claims.withColumn("reason", reason).where("reason is not null").select("claim_id", "reason")


def role_coverage(evidence: DataFrame, wanted: tuple[str, ...] = ("student", "tutor")) -> DataFrame:
    """Per session the roles that evidence has, and whether all wanted ones are there."""
    return evidence.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("roles"), *[F.max((F.col("speaker") == r).cast("int")).alias(f"has_{r}") for r in wanted]).withColumn("complete", F.expr(" + ".join(f"has_{r}" for r in wanted)) == len(wanted))


def grounding(citations: DataFrame, turns: DataFrame, required: DataFrame) -> DataFrame:
    """Per case: precision, recall, role accuracy and quote precision of citations against turns and required evidence.

    citations and required: case_id, session_id, turn_id, speaker, text. A quote may be a part of the turn.
    """
    t = turns.select("session_id", "turn_id", F.col("speaker").alias("true_speaker"), F.col("text").alias("true_text"))
    c = citations.join(t, ["session_id", "turn_id"], "left")
    want = required.select("case_id", "session_id", "turn_id", F.lit(1).alias("wanted")).distinct()
    c = c.join(want, ["case_id", "session_id", "turn_id"], "left")
    role, quote = F.coalesce(F.col("speaker") == F.col("true_speaker"), F.lit(False)), F.coalesce(tx.same_quote(F.col("text"), F.col("true_text")), F.lit(False))
    by = c.groupBy("case_id").agg(F.count("*").alias("cited"), F.count_if(F.col("true_text").isNotNull()).alias("authorized"), F.count_if(role).alias("roles"), F.count_if(quote).alias("quotes"), F.count_if(role & quote).alias("exact"), F.count_distinct(F.when(F.col("wanted").isNotNull() & role & quote, F.struct("session_id", "turn_id"))).alias("found"))
    need = want.groupBy("case_id").agg(F.count("*").alias("needed"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return by.join(need, "case_id", "left").select("case_id", rate("exact", "cited").alias("precision"), rate("found", "needed").alias("recall"), rate("roles", "cited").alias("role_accuracy"), rate("quotes", "cited").alias("quote_precision"), rate("authorized", "cited").alias("authorization"))


def find_quote(quotes: DataFrame, turns: DataFrame) -> DataFrame:
    """quote_id and the first turn of its session that holds the quote, white space aside; null if none does."""
    hit = quotes.join(turns.select("session_id", "turn_id", "text"), "session_id").where(tx.same_quote(F.col("quote"), F.col("text"))).groupBy("quote_id").agg(F.min("turn_id").alias("turn_id"))
    return quotes.select("quote_id").join(hit, "quote_id", "left")


def validate_cards(cards: DataFrame, turns: DataFrame, sessions: DataFrame, role: str, quote: str) -> DataFrame:
    """chunk_id, reason of cards that may not be stored: no session, no pointers, wrong pointers, a quote that isn't there."""
    own = turns.groupBy("session_id").agg(F.collect_list(F.struct("turn_id", "speaker", "text")).alias("t"))
    rows = cards.join(sessions.select("session_id", "question_id").withColumnRenamed("question_id", "q"), "session_id", "left").join(own, "session_id", "left")
    points = F.filter("t", lambda t: F.array_contains(F.col("source_turn_ids"), t["turn_id"]))
    reason = (
        F.when(F.col("q").isNull(), "NO_SESSION")
        .when(F.col("q") != F.col("question_id"), "WRONG_QUESTION")
        .when(F.size("source_turn_ids") == 0, "NO_POINTERS")
        .when(F.size(points) < F.size(F.array_distinct("source_turn_ids")), "MISSING_TURN")
        .when(F.exists(points, lambda t: t["speaker"] != role), "WRONG_ROLE")
        .when(~F.exists(points, lambda t: tx.same_quote(F.col(quote), t["text"])), "QUOTE_NOT_VERBATIM")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select("chunk_id", "reason")


def merge_audit(cards: DataFrame, audit: DataFrame, turns: DataFrame, role: str) -> DataFrame:
    """Cards (chunk_id, session_id, source_turn_ids, quotes) with the pointers that a second look (chunk_id, turn_ids) adds, and their texts among the quotes.

    An added turn that isn't there or isn't the role's raises; a text that a quote already says in canonical form isn't added.
    """
    added = audit.select("chunk_id", F.explode("turn_ids").alias("turn_id")).join(cards.select("chunk_id", "session_id"), "chunk_id")
    known = added.join(turns.select("session_id", "turn_id", "speaker"), ["session_id", "turn_id"], "left")
    wrong = known.where(F.col("speaker").isNull() | (F.col("speaker") != role)).select("chunk_id", "turn_id").first()
    if wrong:
        raise ValueError(f"audit of {wrong.chunk_id} points to turn {wrong.turn_id}, which isn't the {role}'s")
    all_ids = cards.select("chunk_id", "session_id", F.explode("source_turn_ids").alias("turn_id")).unionByName(added.select("chunk_id", "session_id", "turn_id")).distinct()
    told = all_ids.join(turns.select("session_id", "turn_id", "text"), ["session_id", "turn_id"], "left").withColumn("key", tx.canonical_pandas(F.coalesce("text", F.lit(""))))
    by = told.groupBy("chunk_id").agg(F.array_sort(F.collect_set("turn_id")).alias("ids"), F.sort_array(F.collect_list(F.struct("turn_id", "text", "key"))).alias("told"))
    said = cards.select("chunk_id", F.explode("quotes").alias("q")).withColumn("key", tx.canonical_pandas("q")).groupBy("chunk_id").agg(F.collect_set("key").alias("keys"))
    rows = cards.join(by, "chunk_id", "left").join(said, "chunk_id", "left")
    keys, told = F.coalesce("keys", F.array().cast("array<string>")), F.coalesce("told", F.array().cast("array<struct<turn_id:int,text:string,key:string>>"))
    fresh = F.filter(told, lambda t, i: ~F.array_contains(keys, t["key"]) & ~F.exists(F.slice(told, F.lit(1), i), lambda u: u["key"] == t["key"]))
    return rows.select("chunk_id", "session_id", F.coalesce("ids", "source_turn_ids").alias("source_turn_ids"), F.concat("quotes", F.transform(fresh, lambda t: t["text"])).alias("quotes"))


def id_parity(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, side of ids that only one table has."""
    a = expected.select(key).distinct().withColumn("e", F.lit(True))
    b = actual.select(key).distinct().withColumn("a", F.lit(True))
    return a.join(b, key, "full_outer").where("e is null or a is null").select(key, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side"))


def orphan_rows(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent isn't there; a null parent counts as none."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def meaningful(column: str):
    """Whether a metadata value says anything: not blank, and as JSON no empty list or object."""
    c = F.trim(F.col(column))
    return F.coalesce((c != "") & ~F.regexp_replace(c, "\\s", "").isin("[]", "{}", "null"), F.lit(False))
