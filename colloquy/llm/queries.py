"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, chat, collocations, decontaminate, kmv, minhash, packing, pii, quality, secrets, simhash, toxicity, warc
from .common import read_table


# Each query reads a whole table. Null and empty texts, ties, repeated rows, empty tables and further columns have the
# results that its operator's docstring states; a query passes them on as they are.


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, for null and empty texts too."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each benchmark item in it; null and empty texts hold none."""
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 50; unusable vectors take no part, ties go to the smaller id."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation; null roles are unknown, null texts empty, repeated rows count once."""
    out = chat.preference_pairs(chat.self_pairs(read_table(spark, sf_dir, "conversations")))
    return out.withColumnRenamed("pair_id", "conv_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts hold no secret."""
    out = secrets.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece; a null or empty text is its end id alone."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts hold no personal data."""
    out = pii.scan(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), pii.digest().alias("base_sha256"), "spans")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null, empty and blank texts share fingerprint zero and a component."""
    out = simhash.components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page; a null html is an empty payload."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, for null and empty texts too."""
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null, empty and blank texts are linked with nothing."""
    return minhash.components(read_table(spark, sf_dir, "documents"))


def op12_kmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each day with a used click and each ordered pair of kinds."""
    return kmv.window_algebra(read_table(spark, sf_dir, "clicks"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language, counted over all texts."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_ann": op3_ann,
    "op4_chat": op4_chat,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_minhash": op11_minhash,
    "op12_kmv": op12_kmv,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT conv_id, role, coalesce(text, '') AS x,
                     '<|' || replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), chr(10), ' ') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS s,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM t),
        a AS (SELECT conv_id, min(i) FILTER (WHERE role = 'assistant') AS f, coalesce(max(i) FILTER (WHERE role = 'assistant'), max(i)) AS l FROM o GROUP BY conv_id),
        p AS (SELECT a.conv_id, f, l, sl.s AS last_s, '<|assistant|>' || chr(10) || replace(sf.x, '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS first_s, f IS NULL OR sf.x = sl.x AS same
              FROM a JOIN o AS sl ON sl.conv_id = a.conv_id AND sl.i = l JOIN o AS sf ON sf.conv_id = a.conv_id AND sf.i = CASE WHEN f < l THEN f ELSE 1 END),
        q AS (SELECT p.*, CASE WHEN same THEN l ELSE l - 1 END AS n FROM p),
        r AS (SELECT q.conv_id, string_agg(o.s, '' ORDER BY o.i) AS prompt FROM q JOIN o ON o.conv_id = q.conv_id AND o.i <= q.n GROUP BY q.conv_id)
        SELECT q.conv_id, CAST(q.n AS BIGINT) AS prompt_turns, coalesce(r.prompt, '') AS prompt,
               CASE WHEN same THEN '' ELSE last_s END AS chosen, CASE WHEN same THEN '' ELSE first_s END AS rejected,
               CASE WHEN same THEN '' ELSE '14:' || length(last_s) END AS chosen_mask,
               CASE WHEN same THEN '' ELSE '14:' || length(first_s) END AS rejected_mask
        FROM q LEFT JOIN r ON r.conv_id = q.conv_id
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        m AS (SELECT html, max(page_id) AS stored FROM p WHERE n >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN m.stored <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.stored <> p.page_id THEN m.stored END AS refers_to
        FROM p LEFT JOIN m ON p.html = m.html
    """,
    "op11_minhash": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM d WHERE length(w) > 0))),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
        reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(least.other, d.doc_id)) AS BIGINT) AS component_id,
               d.doc_id <= coalesce(least.other, d.doc_id) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
    "op12_kmv": """
        WITH u AS (SELECT DISTINCT client_id, kind, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day,
                          CAST('0x' || substr(md5(CAST(client_id AS VARCHAR)), 1, 16) AS UBIGINT) AS h
                   FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
        days AS (SELECT DISTINCT day FROM u),
        kinds AS (SELECT DISTINCT kind FROM u),
        ends AS (SELECT day AS d FROM days UNION SELECT day - 30 FROM days),
        m AS (SELECT DISTINCT e.d, u.kind, u.client_id, u.h FROM ends e JOIN u ON u.day BETWEEN e.d - 27 AND e.d),
        n AS (SELECT d, kind, count(*) AS n FROM m GROUP BY d, kind),
        s AS (SELECT d, kind, h FROM m QUALIFY row_number() OVER (PARTITION BY d, kind ORDER BY h) <= 2048),
        p AS (SELECT day, a.kind AS kind_a, b.kind AS kind_b FROM days, kinds a, kinds b),
        both_ AS (SELECT p.day, kind_a, kind_b, count(*) AS n FROM p JOIN m a ON a.d = p.day AND a.kind = kind_a
                  JOIN m b ON b.d = p.day - 30 AND b.kind = kind_b AND b.client_id = a.client_id GROUP BY p.day, kind_a, kind_b),
        e AS (SELECT p.*, coalesce(na.n, 0) AS a, coalesce(nb.n, 0) AS b, coalesce(both_.n, 0) AS ab FROM p
              LEFT JOIN n na ON na.d = p.day AND na.kind = kind_a LEFT JOIN n nb ON nb.d = p.day - 30 AND nb.kind = kind_b
              LEFT JOIN both_ USING (day, kind_a, kind_b)),
        sides AS (SELECT p.day, kind_a, kind_b, h, 0 AS side FROM p JOIN s ON s.d = p.day AND s.kind = kind_a
                  UNION ALL SELECT p.day, kind_a, kind_b, h, 1 FROM p JOIN s ON s.d = p.day - 30 AND s.kind = kind_b),
        sample AS (SELECT day, kind_a, kind_b, h, min(side) = 0 AS in_a, max(side) = 1 AS in_b FROM sides GROUP BY day, kind_a, kind_b, h
                   QUALIFY row_number() OVER (PARTITION BY day, kind_a, kind_b ORDER BY h) <= 2048),
        c AS (SELECT day, kind_a, kind_b, count(*) AS k, max(h) AS top, CAST(count(*) FILTER (WHERE in_a AND in_b) AS DOUBLE) AS ab,
                     CAST(count(*) FILTER (WHERE in_a AND NOT in_b) AS DOUBLE) AS a FROM sample GROUP BY day, kind_a, kind_b),
        t AS (SELECT *, 2047 / ((CAST(top AS DOUBLE) + 1) / power(2, 64)) AS n FROM c),
        x AS (SELECT *, greatest(0.0, 1 - 2048 / n) AS rest, 3 * n * sqrt(greatest(0.0, 1 - 2048 / n) / 2046) AS err,
                     9 * greatest(0.0, 1 - 2048 / n) / 2048 AS z, ab / 2048 AS pb, a / 2048 AS pa FROM t),
        y AS (SELECT *, n * greatest((pb + z / 2) / (1 + z) + sqrt(z * pb * (1 - pb) + z * z / 4) / (1 + z) - pb, pb - (pb + z / 2) / (1 + z) + sqrt(z * pb * (1 - pb) + z * z / 4) / (1 + z)) AS eb,
                     n * greatest((pa + z / 2) / (1 + z) + sqrt(z * pa * (1 - pa) + z * z / 4) / (1 + z) - pa, pa - (pa + z / 2) / (1 + z) + sqrt(z * pa * (1 - pa) + z * z / 4) / (1 + z)) AS ea FROM x)
        SELECT CAST(e.day AS BIGINT) AS day, e.kind_a, e.kind_b, CAST(e.a + e.b - e.ab AS BIGINT) AS n_union, CAST(e.ab AS BIGINT) AS n_both, CAST(e.a - e.ab AS BIGINT) AS n_only_a,
               CASE WHEN k = 2048 THEN y.n ELSE CAST(coalesce(k, 0) AS DOUBLE) END AS est_union,
               CASE WHEN k = 2048 THEN pb * y.n ELSE coalesce(y.ab, 0.0) END AS est_both,
               CASE WHEN k = 2048 THEN pa * y.n ELSE coalesce(y.a, 0.0) END AS est_only_a,
               CASE WHEN k = 2048 THEN err + 1 ELSE 0.0 END AS err_union,
               CASE WHEN k = 2048 THEN sqrt(eb * eb + (pb * err) * (pb * err)) + 1 ELSE 0.0 END AS err_both,
               CASE WHEN k = 2048 THEN sqrt(ea * ea + (pa * err) * (pa * err)) + 1 ELSE 0.0 END AS err_only_a
        FROM e LEFT JOIN y USING (day, kind_a, kind_b)
    """,
    "op13_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, len, list_slice(w, i, i + len - 1) AS g FROM (SELECT lang, w, len, unnest(range(1, length(w) - len + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS len))),
        n AS (SELECT lang, CAST(sum(length(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
        f AS (SELECT lang, len, g, count(*) AS f FROM grams GROUP BY lang, len, g HAVING count(*) >= 30),
        cuts AS (SELECT lang, len, g, f AS a, unnest(range(1, len)) AS k FROM f WHERE len >= 2),
        scored AS (SELECT c.*, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score FROM cuts c
                   JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, c.len)),
        low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        parts AS (SELECT lang, list_slice(g, i, i + m - 1) AS g, f FROM (SELECT lang, g, f, m, unnest(range(1, len - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE len > m)),
        longest AS (SELECT lang, g, max(f) AS f FROM parts GROUP BY lang, g),
        kept AS (SELECT low.*, array_to_string(low.g, ' ') AS phrase FROM low LEFT JOIN longest USING (lang, g) WHERE longest.f IS NULL OR 100::HUGEINT * longest.f < 80::HUGEINT * low.a)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept k JOIN n USING (lang) QUALIFY rank <= 2000
    """,
}
