"""Lexical and vector retrieval and their fusion, for one query or many at once.

Every operator takes a queries table, so a batch of queries is one job. Postings and statistics are tables;
words that no query has are dropped before anything is shuffled. What comes from the queries is broadcast if it
is small, which is counted, and joined otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring as sc, text as tx
from . import cards as met


def metadata_matches(columns: dict[str, Column], where: dict) -> Column:
    """Equality, $eq, $in and $ne on metadata; a missing key is null, which equals null; other operators don't restrict."""
    out = F.lit(True)
    for key, wanted in where.items():
        c = columns.get(key, F.lit(None))
        if isinstance(wanted, dict):
            if "$eq" in wanted:
                out = out & c.eqNullSafe(F.lit(wanted["$eq"]))
            if "$in" in wanted:
                values = [v for v in wanted["$in"] if v is not None]
                out = out & (F.coalesce(c.isin(*values), F.lit(False)) | (c.isNull() if None in wanted["$in"] else F.lit(False)))
            if "$ne" in wanted:
                out = out & ~c.eqNullSafe(F.lit(wanted["$ne"]))
        else:
            out = out & c.eqNullSafe(F.lit(wanted))
    return out


#: Rows of a query set that go to every task at most.
SMALL = 200_000


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """Rows marked for broadcast if they are few; counting stops at the bound."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def postings(documents: DataFrame) -> DataFrame:
    """term, id, tf, length of each document (id, document)."""
    words = documents.select("id", tx.tokens(F.col("document")).alias("t"))
    return words.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def collection_statistics(documents: DataFrame) -> DataFrame:
    """documents, mean_length: one row, over all documents, whatever is filtered later. Tokens are counted, not collected."""
    return documents.agg(F.count("*").alias("documents"), F.avg(tx.token_count(F.col("document"))).alias("mean_length"))


def bm25(documents: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, bm25 of each document that has a term of the query; repeated query terms count once."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b within 0 and 1")
    terms = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))
    few = terms.limit(SMALL + 1).count() <= SMALL
    mark = F.broadcast if few else lambda rows: rows
    asked = mark(terms.select("term").distinct())
    words = documents.select("id", tx.tokens(F.col("document")).alias("t")).select("id", F.size("t").alias("length"), F.explode("t").alias("term"))
    # words that no query has go before the shuffle; a term's documents are spread, as they are dealt by document
    p = words.join(asked, "term", "left_semi").groupBy("id", "term", "length").agg(F.count("*").alias("tf"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    weighed = mark(terms.join(df, "term"))  # no more rows than terms
    scored = p.join(weighed, "term").crossJoin(F.broadcast(collection_statistics(documents)))  # one row
    weight = sc.okapi(F.col("tf"), F.col("df"), F.col("length"), F.col("documents"), F.greatest("mean_length", F.lit(1e-9)), k1, b)
    return scored.groupBy("query_id", "id").agg(F.sum(weight).alias("bm25"))


def top(rows: DataFrame, by: list, k: int, group: str = "query_id") -> DataFrame:
    """The first k rows of each group by a total order, with their rank; tasks drop the rest before the shuffle."""
    if k < 1:
        raise ValueError("k must be positive")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("rank") <= k)


def hashed_features(text: Column) -> Column:
    """Words and pairs of characters of a lower-case text, in linear time: characters are split once and zipped with their successors."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("(?U)\\w+"), F.lit(0))
    chars = F.filter(F.split(low, ""), lambda c: c != "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.length(low), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def hashed_vectors(documents: DataFrame, dim: int = 128) -> DataFrame:
    """id, i, v: the components of a unit vector from hashed features; their place and sign come from md5.

    dim is a power of two up to 256, so the last byte alone decides the place. Signs are summed by place before
    the shuffle, so at most dim rows of a document move.
    """
    if dim not in (2, 4, 8, 16, 32, 64, 128, 256):
        raise ValueError("dim must be a power of two up to 256")
    digests = documents.select("id", F.explode(hashed_features(F.col("document"))).alias("f")).select("id", F.unhex(F.substring(F.md5("f"), 29, 4)).alias("h"))
    byte = lambda at: F.conv(F.hex(F.substring("h", at, 1)), 16, 10).cast("int")
    parts = digests.select("id", (byte(2) % dim).alias("i"), F.when(byte(1) % 2 == 0, 1).otherwise(-1).alias("v")).groupBy("id", "i").agg(F.sum("v").cast("double").alias("v")).where("v <> 0")
    return parts.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id"))))


def vector_scores(vectors: DataFrame, queries: DataFrame, alpha: float = 0.5) -> DataFrame:
    """query_id, id, cos, distance, dense of every vector (id, embedding) for a stated set of queries (query_id, query_vector).

    A small set goes to each task: vectors are read once and never shuffled.
    """
    both = vectors.select("id", "embedding").crossJoin(small(queries.select("query_id", "query_vector"), SMALL // 20))
    cos, dist = sc.cosine(F.col("embedding"), F.col("query_vector")), sc.euclidean(F.col("embedding"), F.col("query_vector"))
    rows = both.select("query_id", "id", cos.alias("cos"), dist.alias("distance"))
    return rows.withColumn("dense", sc.dense(F.col("cos"), sc.distance_similarity(F.col("distance")), alpha))


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, weight: float = 0.35, queries: int | None = None) -> DataFrame:
    """Pools of both lanes put together, rescored and ranked: query_id, id, dense, bm25, hybrid, channels, rank.

    Each pool has max(5k, 20) documents; lexical scores count as a share of the best in the pool. A document of
    one pool has its own score of the other lane too, 0 where it has none. Pools are cut before they are shuffled.
    With the number of queries given, and pools that are small in all, dense scores are looked up where they are
    made, so pairs outside the pools never move; lexical scores lie where their sums were made.
    """
    pool = max(5 * k, 20)
    d = top(dense, [F.desc("dense"), F.asc("id")], pool).select("query_id", "id", F.lit("dense").alias("channel"))
    x = top(lexical.where("bm25 > 0"), [F.desc("bm25"), F.asc("id")], pool).select("query_id", "id", F.lit("bm25").alias("channel"))
    ids = d.unionByName(x).groupBy("query_id", "id").agg(F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"))
    own = dense.select("query_id", "id", "dense")
    if queries is not None and 2 * pool * queries <= SMALL:
        own = own.join(F.broadcast(ids.select("query_id", "id")), ["query_id", "id"], "left_semi")
    rows = ids.join(own, ["query_id", "id"], "left").join(lexical, ["query_id", "id"], "left")
    rows = rows.withColumns({"dense": F.coalesce("dense", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("hybrid", sc.hybrid(F.col("dense"), F.col("bm25"), best, weight))
    return top(rows, [F.desc("hybrid"), F.desc("bm25"), F.desc("dense"), F.asc("id")], k)


def fuse(lanes: DataFrame, k: int = sc.RRF_K) -> DataFrame:
    """query_id, id, rrf, best_rank, lanes from ranked lanes (query_id, lane, id, rank)."""
    return lanes.groupBy("query_id", "id").agg(F.sum(sc.rrf(F.col("rank"), k)).alias("rrf"), F.min("rank").alias("best_rank"), F.count("*").alias("lanes"))


def fuse_raw_first(lanes: DataFrame, raw: str, k: int = sc.RRF_K) -> DataFrame:
    """The raw lane in its own order, then the rest by fused score: adds position."""
    scored = lanes.groupBy("query_id", "id").agg(F.sum(sc.rrf(F.col("rank"), k)).alias("rrf"), F.min(F.when(F.col("lane") == raw, F.col("rank"))).alias("raw_rank"))
    by = Window.partitionBy("query_id").orderBy(F.coalesce("raw_rank", F.lit(2**31 - 1)), F.desc("rrf"), "id")
    return scored.withColumn("position", F.row_number().over(by))


def attach_evidence(hits: DataFrame, cards: DataFrame, turns: DataFrame) -> DataFrame:
    """Hits (id = chunk_id) with their cards' turns as an ordered array of struct: all hits in one join, not one by one."""
    points = hits.join(cards.select(F.col("chunk_id").alias("id"), "session_id", "source_turn_ids"), "id").withColumn("turn_id", F.explode("source_turn_ids"))
    held = points.join(turns, ["session_id", "turn_id"]).groupBy("id", "session_id").agg(F.sort_array(F.collect_set(F.struct("turn_id", "speaker", "text"))).alias("evidence"))
    return hits.join(held, "id", "left")


# Words by which a query names a lane, a review, a question id; and words of the domain.
TUTOR_WORDS = ("导师", "老师", "教学策略", "引导", "tutor", "teacher", "strategy")
STUDENT_WORDS = ("学生", "错因", "误区", "困惑", "student", "misconception")
REVIEW_WORDS, ID_WORDS = ("回顾",), ("题目", "question", "qid")
DOMAIN_WORDS = ("舍入", "round", "fraction", "分数", "ratio", "median", "probability", "temperature", "angle", "volume", "function")
#: A question's beginning counts from so many characters on.
FRAGMENT = 8


def _names(text: Column, words: tuple[str, ...]) -> Column:
    return tx.any_of([F.contains(F.lower(text), F.lit(w)) for w in words])


def _long_words(text: Column) -> Column:
    return F.filter(tx.word_set(text), lambda w: F.length(w) > 1)


def _domain(text: Column) -> Column:
    """Numbers of the domain words that stand in a text, within other words too."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(w)), i) for i, w in enumerate(DOMAIN_WORDS)]))


def _asked(queries: DataFrame) -> DataFrame:
    """What scores need of a query, once a query: words, numbers, the question in it, ids, domain words, and the lane it names."""
    q = F.col("query")
    ids = F.transform(F.regexp_extract_all(q, F.lit(r"(?<!\d)\d{5,18}(?!\d)"), F.lit(0)), lambda x: x.cast("long"))
    tutor, student = _names(q, TUTOR_WORDS), _names(q, STUDENT_WORDS)
    return queries.select(
        "query_id", "query", _long_words(q).alias("q_words"), tx.signatures(q).alias("q_numbers"), tx.compact(tx.question_fragment(q)).alias("q_fragment"), ids.alias("q_ids"),
        F.when(tutor, "TUTOR_STRATEGY").when(student, "MISCONCEPTION").alias("q_lane"),
        F.when(tutor & ~student, "TUTOR_STRATEGY").when(student & ~tutor, "MISCONCEPTION").alias("q_prefers"),
        _names(q, REVIEW_WORDS).alias("q_reviews"), (_names(q, ID_WORDS) & (F.size(ids) > 0)).alias("q_by_id"), _domain(q).alias("q_domain"),
    )


def _described(cards: DataFrame) -> DataFrame:
    question = F.coalesce(F.col("question_text"), F.lit(""))
    more = cards if "question_id" in cards.columns else cards.withColumn("question_id", F.lit(None).cast("long"))
    return more.select("chunk_id", "card_type", "session_id", "question_id", "searchable", _long_words(question).alias("c_question"), _long_words(F.col("searchable")).alias("c_words"), tx.compact(question).alias("c_fragment"), F.regexp_replace(question, r"\D", "").alias("c_digits"), _domain(F.col("searchable")).alias("c_domain"))


def _pairs(cards: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id of cards that can score: they share a word, a word of the domain within others, a question's beginning, two digits, an id or the lane."""
    tag = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(kind), x.cast("string")))
    start = lambda c: F.when(F.length(c) >= FRAGMENT, F.array(F.substring(c, 1, FRAGMENT))).otherwise(F.array().cast("array<string>"))
    digits = F.transform(F.sequence(F.lit(1), F.greatest(F.length("c_digits") - 1, F.lit(1))), lambda i: F.substr(F.col("c_digits"), i, F.lit(2)))
    of_card = F.concat(tag("w", F.array_union("c_question", "c_words")), tag("b", start(F.col("c_fragment"))), tag("n", digits), tag("i", F.array_compact(F.array("question_id"))), tag("d", F.col("c_domain")), tag("l", F.array("card_type")))
    of_query = F.concat(tag("w", F.col("q_words")), tag("b", start(F.col("q_fragment"))), tag("n", F.transform("q_numbers", lambda x: F.substring(x, 1, 2))), tag("i", F.col("q_ids")), tag("d", F.col("q_domain")), tag("l", F.array_compact(F.array("q_lane"))))
    left = cards.select("chunk_id", F.explode(F.array_distinct(of_card)).alias("key"))
    right = small(asked.select("query_id", F.explode(F.array_distinct(of_query)).alias("key")))
    return left.join(right, "key").select("query_id", "chunk_id").distinct()


def _features(pairs: DataFrame, cards: DataFrame, asked: DataFrame) -> DataFrame:
    both = pairs.join(cards, "chunk_id").join(small(asked), "query_id")
    exact = F.coalesce(F.array_contains("q_ids", F.col("question_id")), F.lit(False)) & (F.size("q_ids") > 0)
    numeric = F.size(F.filter("q_numbers", lambda s: F.contains(F.col("c_digits"), s)))
    prefix = F.when((F.length("q_fragment") >= FRAGMENT) & F.startswith("c_fragment", F.col("q_fragment")), F.length("q_fragment")).otherwise(0)
    shared = lambda c: F.size(F.array_intersect("q_words", c))
    domain = F.when(F.col("query").isNotNull() & F.col("searchable").isNotNull(), F.size(F.array_intersect("q_domain", "c_domain")))
    rows = both.where(~F.col("q_by_id") | exact).select(
        "query_id", "chunk_id", "card_type", "session_id", "q_prefers", "q_reviews", exact.cast("int").alias("exact_question"), numeric.alias("numeric_overlap"), prefix.alias("question_prefix"),
        shared("c_question").alias("question_overlap"), domain.alias("domain_overlap"), shared("c_words").alias("lexical_overlap"), F.when(F.col("card_type") == F.col("q_lane"), 100).otherwise(0).alias("lane_bias"),
    )
    score = (F.col("exact_question") + F.col("numeric_overlap")) * 1000 + F.col("question_prefix") * 100 + F.col("question_overlap") * 10 + F.col("domain_overlap") * 20 + F.col("lane_bias") + F.col("lexical_overlap")
    return rows.withColumn("score", score.cast("long"))


def card_scores(cards: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Lexical scores of cards (chunk_id, card_type, session_id, question_text, searchable; question_id if there) for a set of queries.

    Seven weighted terms: the question's id or a number of the query in the question 1000 each, a shared beginning of
    eight characters or more 100 a character, words of the domain 20, shared question words 10, shared words 1, and 100
    for the lane that the query names. A query that asks by id scores that question's cards alone. Queries that fit into a
    task meet cards where these are read; others find cards by what they share. With a limit, cards that `rank_cards`
    wouldn't keep under it may be left out.
    """
    own, asked = _described(cards), _asked(queries)
    kept = asked.where("query_id is not null and query is not null")
    rows = kept.limit(met.QUERIES + 1).collect()  # no more than go to every task
    if len(rows) > met.QUERIES or sum(len(r.q_words) + len(r.q_numbers) + len(r.q_ids) for r in rows) > met.WORDS:
        return _features(_pairs(own, asked), own, asked).where("score > 0")
    told = queries.sparkSession.createDataFrame([(i, r.query_id, r.q_prefers, r.q_reviews) for i, r in enumerate(rows)], f"number int, query_id {queries.schema['query_id'].dataType.simpleString()}, q_prefers string, q_reviews boolean")
    found = met.scores(own.where("chunk_id is not null and searchable is not null"), rows, FRAGMENT, limit).join(F.broadcast(told), "number")  # a row a query
    return found.select("query_id", "chunk_id", "card_type", "session_id", "q_prefers", "q_reviews", *met.FEATURES)


def card_pool(cards: DataFrame, queries: DataFrame, dense: DataFrame, limit: int | None = None) -> DataFrame:
    """Scored cards widened by dense hits (query_id, chunk_id, card_type, embedding_rank, embedding_score), with channels.

    A dense hit brings its card in without a lexical score and never changes one. A hit of an unknown card, or in
    another lane than its card's, raises. With a limit, scored cards that `rank_cards` wouldn't keep may be left out.
    """
    own, asked = _described(cards), _asked(queries)
    lane = dense.join(own.select("chunk_id", F.col("card_type").alias("true_type")), "chunk_id", "left")
    wrong = lane.where("true_type is null or card_type <> true_type").select("chunk_id", "true_type").first()
    if wrong:
        raise ValueError(f"dense hit {wrong.chunk_id} " + ("has no card" if wrong.true_type is None else "is of another lane"))
    hits = dense.groupBy("query_id", "chunk_id").agg(F.min("embedding_rank").alias("embedding_rank"), F.max("embedding_score").alias("embedding_score"))
    alone = _features(hits.select("query_id", "chunk_id"), own, asked).where("coalesce(score, 0) <= 0").join(hits, ["query_id", "chunk_id"]).where("embedding_rank is not null")
    rows = card_scores(cards, queries, limit).join(hits, ["query_id", "chunk_id"], "left").unionByName(alone)
    channels = F.concat_ws("+", F.when(F.col("score") > 0, "lexical"), F.when(F.col("embedding_rank").isNotNull(), "dense"))
    return rows.withColumn("channels", channels)


def card_order(dense: bool) -> list[Column]:
    """The lexicographic order of a query's cards: what they share decides, and dense scores only between equals."""
    c = F.col
    numeric = c("numeric_overlap") > 0
    first = [
        F.when(c("q_prefers").isNull() | (c("card_type") != c("q_prefers")), 1).otherwise(0), F.when(c("q_reviews") & numeric, 0).otherwise(1),
        c("numeric_overlap").desc(), c("question_prefix").desc(), F.when(numeric, c("session_id")).otherwise(F.lit(10**9)), c("question_overlap").desc(),
        c("domain_overlap").desc(), c("lexical_overlap").desc(), c("session_id").asc(), c("chunk_id").asc(),
    ]
    return [*first, F.coalesce("embedding_score", F.lit(0.0)).desc(), F.coalesce("embedding_rank", F.lit(10**9))] if dense else first


def rank_cards(scored: DataFrame, limit: int = 15) -> DataFrame:
    """Cards in their fixed lexicographic order (position), at most `limit` of each lane."""
    order = card_order("embedding_rank" in scored.columns)
    lane = scored.withColumn("lane_rank", F.row_number().over(Window.partitionBy("query_id", "card_type").orderBy(*order))).where(F.col("lane_rank") <= limit)
    return lane.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def parents(lanes: DataFrame, limit: int = 5) -> DataFrame:
    """The best card of each lane, then the best of the rest, up to the limit; lanes: query_id, lane, id, rank, score."""
    first = (F.col("rank") == 1).cast("int")
    by = Window.partitionBy("query_id").orderBy(F.desc(first), F.when(F.col("rank") == 1, F.col("lane")), F.desc("score"), "rank", "id")
    return lanes.withColumn("position", F.row_number().over(by)).where(F.col("position") <= limit)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest by Euclidean distance, exactly: query_id, id, distance, rank."""
    return top(vector_scores(vectors, queries).select("query_id", "id", "distance"), [F.asc("distance"), F.asc("id")], k)


def tfidf_similarity(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, similarity: cosine of smoothed tf-idf vectors."""
    stats = collection_statistics(documents).select("documents")
    p = postings(documents)
    idf = p.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", (F.log((F.col("documents") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = p.join(idf, "term").select("term", "id", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = postings(queries.select(F.col("query_id").alias("id"), F.col("query").alias("document"))).join(idf, "term").select("term", F.col("id").alias("query_id"), (F.col("tf") * F.col("idf")).alias("q"))
    own = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    dots = asked.join(weighted, "term").groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    return dots.join(norms, "id").join(own, "query_id").select("query_id", "id", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("similarity"))


def window_rescore(hits: DataFrame, windows: DataFrame, queries: DataFrame, k: int, weight: float = 0.35) -> DataFrame:
    """Window hits with their score raised by the numbers that they share with the query, in the new order.

    hits: query_id, id, score; windows: id, content, anchor (a header that counts a tenth).
    """
    both = hits.join(windows, "id").join(queries, "query_id")
    exact = tx.numeric_score(F.col("query"), F.col("content"), F.col("anchor"))
    rows = both.select("query_id", "id", exact.alias("exact"), (F.col("score") + weight * exact).alias("score"))
    return top(rows, [F.desc("score"), F.asc("id")], k)
