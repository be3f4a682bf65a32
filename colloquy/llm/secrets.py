"""Secret scans with DataFrame functions only: exact patterns, and a battery of randomness tests.

Runs of 20 or more characters that an encoding might use, with a digit among them, are candidates. The
encoding is inferred from the characters; then three tests ask whether the characters could be uniform and
independent: chi-squared uniformity over the alphabet, runs about its middle, and lag-one serial correlation.
Fisher's method combines them. Within each class of lengths the Benjamini-Hochberg rule, over all candidates of
the table, decides which are not random; a short run needs a smaller p to be told from chance, and each class
has its own threshold. Candidates that the rule does not reject are the secrets that are added.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, materialize, running

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of fewer than 20 can't hold a longer one, so these are the runs that count
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: What a candidate holds: words and numbers as they stand in prose hold no letters beside digits. () lets the tests decide alone.
NEEDS = ("[0-9]", "[A-Za-z]")
#: False rejections of randomness that the rule allows among its rejections.
RATE = 0.05
#: p-values are counted in steps of a hundredth of a decade.
STEPS, LEAST = 100, 1e-290

_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
#: Encodings, the first that fits is inferred: name, pattern, alphabet.
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("upper36", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("lower36", "^[a-z0-9]+$", _DIGITS + _UPPER.lower()),
    ("base62", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _UPPER.lower()),
    ("base64", "", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
)


def located(text: Column, pattern: str, value_group: int = 0) -> Column:
    """start, end (code points) and a group's value of each leftmost non-overlapping match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    # the last gap has no match
    sizes = F.filter(F.zip_with(gaps, F.zip_with(found, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), lambda g, x: F.when(x.isNotNull(), F.struct(F.length(g).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), x["v"].alias("value")))), lambda x: x.isNotNull())

    def placed(xs: Column) -> Column:
        before = running(F.transform(xs, lambda x: x["gap"] + x["size"]))
        return F.zip_with(xs, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))

    return let(sizes, placed)


def _none() -> Column:
    return F.array().cast(_SPAN)


def _normal_upper(z: Column) -> Column:
    """The upper tail of the normal distribution, by a logistic fit (within 2e-4)."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _p_value(chars: Column, alphabet: Column) -> Column:
    """Fisher's combination of the three tests on an array of single characters."""

    def tests(v: Column) -> Column:
        n, k = F.size(v).cast("double"), F.length(alphabet).cast("double")
        squares = F.aggregate(F.sequence(F.lit(1), F.length(alphabet)), F.lit(0.0), lambda acc, j: acc + F.pow(F.size(F.filter(v, lambda x: x == j)).cast("double"), F.lit(2)))
        chi, free = k / n * squares - n, k - 1
        p_even = _normal_upper((F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("a"), F.slice(v, F.lit(2), F.size(v)).alias("b"))
        high = F.size(F.filter(v, lambda x: x * 2 > k)).cast("double")
        both = 2 * high * (n - high)
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] * 2 > k) != (p["b"] * 2 > k)))
        spread = both * (both - n) / (n * n * (n - 1))
        p_runs = F.when(spread > 0, 2 * _normal_upper(F.abs(runs - both / n - 1) / F.sqrt(spread))).otherwise(F.lit(1e-9))
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)

        def serial(mean: Column) -> Column:
            around = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
            along = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mean) * (p["b"] - mean))
            return F.when(around > 0, 2 * _normal_upper(F.abs(along / around + 1 / n) * F.sqrt(n))).otherwise(F.lit(1e-9))

        logs = sum((F.log(F.greatest(p, F.lit(LEAST))) for p in (p_even, p_runs)), F.log(F.greatest(let(total / n, serial), F.lit(LEAST))))
        return let(-logs, lambda x: F.exp(-x) * (1 + x + x * x / 2))

    return let(F.transform(chars, lambda c: F.instr(alphabet, c)), tests)


def tested(spans: Column, needs: tuple[str, ...] = NEEDS) -> Column:
    """Candidates with their p-value that they are random: struct start, end, p; those that lack one of `needs` drop."""
    good = F.filter(spans, lambda s: reduce(and_, [s["value"].rlike(x) for x in needs], F.lit(True)))

    def one(s: Column) -> Column:
        bare = F.translate(F.regexp_replace(s["value"], "=+$", ""), "-_", "+/")

        def of(value: Column) -> Column:
            alphabet = F.lit(ENCODINGS[-1][2])
            for _, pattern, letters in reversed(ENCODINGS[:-1]):
                alphabet = F.when(value.rlike(pattern), F.lit(letters)).otherwise(alphabet)
            chars = F.filter(F.split(value, ""), lambda c: c != "")
            return let(F.struct(chars.alias("chars"), alphabet.alias("alphabet")), lambda x: _p_value(x["chars"], x["alphabet"]))

        return F.struct(s["start"].alias("start"), s["end"].alias("end"), let(bare, of).alias("p"))

    return F.transform(good, one)


def _step(p: Column) -> Column:
    return F.floor(-F.log10(F.greatest(p, F.lit(LEAST))) * STEPS).cast("int")


def _length_class(start: Column, end: Column) -> Column:
    return F.floor(F.log2((end - start).cast("double"))).cast("int")


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[int, int]:
    """By class of lengths, the least step at which a candidate is called not random.

    Counts by step, not candidates, are ordered: at most 29,000 rows in each of at most 31 classes.
    """
    each = candidates.select(F.explode("candidates").alias("c")).select(_length_class(F.col("c.start"), F.col("c.end")).alias("size"), _step(F.col("c.p")).alias("step"))
    counts = each.groupBy("size", "step").agg(F.count("*").alias("n"))
    by = Window.partitionBy("size")
    ranked = counts.select("size", "step", F.sum("n").over(by.orderBy(F.desc("step"))).alias("rank"), F.sum("n").over(by).alias("m"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("rank") / F.col("m"))
    return {r["size"]: r["step"] for r in passed.groupBy("size").agg(F.min("step").alias("step")).collect()}


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of others, which are in order and apart: the last that starts before a span's end is looked up by halving."""

    def among(held: Column) -> Column:
        def before(end: Column) -> Column:
            return F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), F.lit(0), lambda n, step: F.when((step <= F.size(held) - n) & (F.try_element_at(held, n + step)["start"] < end), n + step).otherwise(n))

        clear = lambda s: let(before(s["end"]), lambda n: (n == 0) | (F.get(held, n - 1)["end"] <= s["start"]))
        return F.when(F.size(held) > 0, F.filter(spans, clear)).otherwise(spans)

    return let(others, among)


def _named(spans: Column, kind: int) -> Column:
    """Spans of one kind, in the order in which they sort."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("at"), s["end"].alias("end"), F.lit(KINDS[kind]).alias("kind")))


def scan(docs: DataFrame, rate: float = RATE, needs: tuple[str, ...] = NEEDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans for each row of docs.

    Spans are kind:start:end in code points, comma-joined, by start and then kind; base ones are of the exact
    patterns, and a random one that overlaps any of them is left out. Null texts count as empty; repeated rows
    are each reported; other columns are not read; an empty table gives none. The rate bounds false rejections of
    randomness among the candidates; what isn't rejected may still be no secret.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    # cheap tests first: most texts hold nothing that a pattern could match
    assign = F.when(low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key"), F.filter(located(F.col("text"), ASSIGN, 1), lambda s: F.length(s["value"]) >= 6)).otherwise(_none())
    access = F.when(F.col("text").contains("AKIA"), located(F.col("text"), ACCESS)).otherwise(_none())
    hexes = F.when(F.col("text").rlike("[0-9a-f]{24}"), located(F.col("text"), HEX)).otherwise(_none())
    more = F.when(reduce(and_, [F.col("text").rlike(x) for x in (*needs, "[A-Za-z0-9+/_-]{20}")]), located(F.col("text"), CANDIDATE)).otherwise(_none())
    found = rows.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), more.alias("more"))
    base = F.concat(*[_named(F.col(k), i) for i, k in enumerate(KINDS[:3])])
    # regular expressions ran once per row above: the arrays are passed on as values, not repeated
    bound = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sort_array(base).alias("base"), F.when(F.size("more") > 0, tested(F.col("more"), needs)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,p:double>>")).alias("candidates"))
    held = materialize(bound, "secrets")
    limits = thresholds(held, rate)
    if limits:
        table = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
        limit = lambda c: F.try_element_at(table, _length_class(c["start"], c["end"]))
    else:
        limit = lambda c: F.lit(None).cast("int")

    random = F.filter("candidates", lambda c: limit(c).isNull() | (_step(c["p"]) < limit(c)))
    of = lambda kind: F.filter("base", lambda b: b["kind"] == F.lit(kind))
    for kind in KINDS[:3]:
        random = _apart(random, of(kind))
    added = _named(random, 3)
    spell = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return held.select("doc_id", *[f"n_{k}" for k in KINDS[:3]], F.size(added).cast("long").alias("n_random"), spell(F.col("base")).alias("base_spans"), spell(F.sort_array(F.concat("base", added))).alias("spans"))
