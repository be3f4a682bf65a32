"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A word that may be disguised becomes a lattice of characters: each leet sign may stand for letters,
a run of one letter may be shorter, and gaps between single letters may be no gaps. The Viterbi path
under a character trigram model is the restored word. The score is a logistic regression with a quadratic
penalty over what the restored text holds: words, their beginnings and their character n-grams, with
evidence for and against. Features come from the labelled sample by a likelihood-ratio test.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fold, labelled_sample, materialize, small_batches

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that a fit reads at most.
FIT_ROWS = 20_000
#: Features that a model holds at most, those of most evidence; its trigrams are those of all documents, as many as there are.
MAX_FEATURES = 50_000
#: A feature needs so many distinct words before it, so copies of one text don't make one, so much evidence in nats, and a share of toxic documents so many times the usual one or below.
CONTEXTS, EVIDENCE, EFFECT = 3, 3.0, 2.0
#: Words that are looked for in disguise have such a share of toxic documents, and a chance below this that any of them came by luck.
PRECISION, ERROR = 0.9, 1e-3
BEGINNINGS, GRAMS = (4, 5, 6), (3, 4, 5)
#: The quadratic penalty of the regression, and its rounds.
PENALTY, ROUNDS = 0.3, 200
#: What a sign may stand for, and the cost of that reading in nats.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "×": "x",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i",
}
CHANNEL, UNSEEN, SKIP, GAP = 1.0, -14.0, 0.2, 1.0
#: Words whose evidence a task holds; words or features whose counts a task of the fit holds.
CACHE_WORDS, COUNTED = 200_000, 150_000
#: Tasks that share the labelled documents.
PARTS = 32

_SIGNS = frozenset(LEET)
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t.\-_*~]{1,3}[^\s.\-_*~]){3,}(?!\w)")
_DOTTED = re.compile(r"\S(?:[.\-_*~][^\s.\-_*~]){3,}[.,;:!?]*")
_DOUBLE = re.compile(r"(.)\1+")
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_GAPS = frozenset(" \t.-_*~")


def clean(word: str) -> str:
    """Lower case, compatibility forms, no hidden characters, no punctuation around it."""
    if not word.isascii():
        word = unicodedata.normalize("NFKC", word).translate(_HIDDEN)
    return word.lower().rstrip(".,;:!?\"')]}").lstrip("\"'([{")


def features(word: str) -> set[str]:
    """Each part of a restored word between ^ and $, its beginnings, and all n-grams of these: pieces of what ends() gives."""
    out = set()
    for part in _LETTERS.findall(word):
        marked = f"^{part}$"
        out.add(marked)
        out.update([marked[: n + 1] for n in BEGINNINGS if len(part) >= n])
        out.update([marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)])
    return out


def ends(word: str) -> str:
    """The letter parts of a word between their marks."""
    return f"^{word}$" if word.isalpha() else "".join([f"^{part}$" for part in _LETTERS.findall(word)])


@dataclass
class Channel:
    """A character trigram model as log-probabilities, and the Viterbi decoder over lattices."""

    trigrams: dict[str, float]
    backoff: dict[str, float]

    def step(self, two: str, c: str) -> float:
        got = self.trigrams.get(two + c)
        return got if got is not None else self.backoff.get(c, UNSEEN) - 2.0

    def decode(self, seen: str) -> str:
        """The likeliest reading of seen, over all paths: lower case; a gap is a character of _GAPS.

        A state is the last two characters read, so there are at most the squared number of readings of a sign.
        """
        beams: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}  # the text as its last character and what stood before
        before = ""
        for c in seen:
            after: dict[str, tuple[float, tuple | None]] = {}

            def put(two: str, value: float, text: tuple | None) -> None:
                old = after.get(two)
                if old is None or value > old[0]:
                    after[two] = (value, text)

            readings = [(c, 0.0), *((x, CHANNEL) for x in LEET.get(c, ""))]
            for two, (value, text) in beams.items():
                if c in _GAPS:
                    put(two, value - SKIP, text)
                    if two[1] != " ":
                        put("  ", value + self.step(two, " ") - GAP, (text, " "))
                    continue
                if c == before:  # a run read as one letter
                    put(two, value - SKIP, text)
                for x, cost in readings:
                    put(two[1] + x, value + self.step(two, x) - cost, (text, x))
            beams, before = after, c
        text, out = max(((value + self.step(two, " "), text) for two, (value, text) in beams.items()), key=lambda v: v[0])[1], []
        while text:
            text, x = text
            out.append(x)
        return "".join(reversed(out))


class Model:
    """Weights of features, the channel, the log-odds of a document without features, and the words looked for in disguise.

    An automaton over the features finds all that a word holds in one pass.
    """

    def __init__(self, weights: dict[str, float], channel: Channel, prior: float, strong: frozenset[str] | None = None) -> None:
        self.weights, self.channel, self.prior = weights, channel, prior
        self.strong = frozenset(x for x, w in weights.items() if w >= 1 and len(x) > 4) if strong is None else strong
        #: No word is looked for unless it begins so, once runs of a letter count as one letter.
        self.starts = {_DOUBLE.sub(r"\1", x.strip("^$"))[:3] for x in self.strong}
        self.begun = {x[:n] for x in self.starts for n in (1, 2)}
        self.longest = max(map(len, self.strong), default=0)
        self.automaton = ahocorasick.Automaton()
        for x in weights:
            self.automaton.add_word(x, x)
        if weights:
            self.automaton.make_automaton()
        self.cache = _Words(self)

    def __reduce__(self):
        return Model, (self.weights, self.channel, self.prior, self.strong)

    def plain(self, word: str) -> tuple[str, ...]:
        """The features of a word that have weight."""
        return tuple([x for _, x in self.automaton.iter(ends(word))]) if self.weights else ()

    def weigh(self, found) -> float:
        return sum(map(self.weights.__getitem__, set(found)))

    def may(self, word: str, anywhere: bool) -> bool:
        """Whether a reading of the word holds the start of one that is looked for, after a sign or (if so asked) anywhere."""
        found: set[str] = {""}
        for c in word:
            if c in _GAPS:
                found = {*found, ""}
                continue
            after: set[str] = set()
            for x in (c, *LEET.get(c, "")):
                if x.isalpha():
                    for got in found:
                        now = got if got.endswith(x) else got + x
                        if now in self.starts:
                            return True
                        if now in self.begun:
                            after.add(now)
            if anywhere or not c.isalpha():
                after.add("")
            found = after
        return False

    def evidence(self, raw: str) -> tuple[str, ...]:
        """Features of a raw word as the channel reads it, or as it stands if that weighs more.

        A word isn't decoded if its lattice has one path, or if no reading holds what is looked for.
        """
        word = clean(raw)
        own = self.plain(word)
        leet, dotted = not _SIGNS.isdisjoint(word), bool(_DOTTED.fullmatch(word))
        if not (leet or dotted or _DOUBLE.search(word) or not _GAPS.isdisjoint(word)):
            return own
        if not leet and word.isalpha():
            once = _DOUBLE.sub(r"\1", word)
            if self.starts.isdisjoint((once[:1], once[:2], once[:3])):
                return own
        anywhere = dotted or leet and not word.isalpha() and not _GAPS.isdisjoint(word)
        return max(own, self.run(word, anywhere), key=self.weigh) if self.may(word, anywhere) else own

    def word(self, raw: str) -> float:
        """What the evidence of a raw word weighs."""
        return self.weigh(self.evidence(raw))

    def run(self, seen: str, anywhere: bool = True) -> tuple[str, ...]:
        """Features of what a lattice reads; with gaps in it and if so asked, a word looked for may begin after any of them."""
        read = self.channel.decode(seen)
        out = [x for part in read.split() for x in self.plain(part)]
        if anywhere and not _GAPS.isdisjoint(seen):
            for part in _LETTERS.findall("".join(read.split())):
                for i in range(len(part)):
                    for n in range(BEGINNINGS[0], min(self.longest, len(part) - i) + 1):
                        if f"^{part[i : i + n]}$" in self.strong:
                            out += self.plain(part[i : i + n])
                        elif n in BEGINNINGS and f"^{part[i : i + n]}" in self.strong:
                            out.append(f"^{part[i : i + n]}")
        return tuple([x for x in out if x in self.weights])

    def found(self, text: str | None) -> set[str]:
        """The features in a restored text. Null counts as empty."""
        words = set((text or "").split())
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        out = set().union(*filter(None, map(self.cache.__getitem__, words)))
        return out.union(*(self.run(m.group().lower()) for m in _SPACED.finditer(text or "")))

    def score(self, text: str | None) -> float:
        """0 to 1: the logistic of what the restored text holds."""
        logit = self.prior + sum(map(self.weights.__getitem__, self.found(text)))
        return 1 / (1 + exp(-max(-30.0, min(30.0, logit))))


class _Words(dict):
    """The evidence of each raw word seen; a subclass for __missing__, so known words never leave C."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, raw: str) -> tuple[str, ...]:
        got = self[raw] = self.model.evidence(raw)
        return got


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = FIT_ROWS) -> Model:
    """Trigrams of whole words from all documents; features and their weights from at most `bound` labelled ones.

    Counts are summed where the rows lie. A document counts once for each feature in it, and equal texts are one row
    of the regression. With no labelled rows the model holds nothing and every score is below 0.5. Null texts count
    as empty; labels of ids that docs lacks take no part; other columns are not read; an empty table fits nothing.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, target, folds, held_out, bound)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    channel = _channel({r.g: r.n for r in _trigrams(texts).collect()})
    labelled = materialize(texts.join(F.broadcast(sample), "doc_id").select(F.col("y"), "text"), "labelled")
    words = materialize(_words(labelled), "words")
    toxic, others = next(((r.t, r.c) for r in words.where("w = '#docs'").collect()), (0, 0))
    prior = log((toxic + 1) / (others + 1)) if toxic + others else -2.0
    if not toxic or not others:
        return Model({}, channel, min(prior, -2.0) if not toxic else max(prior, 2.0), frozenset())
    sums = materialize(_counts(words), "features")
    all_words = sums.where("f = '#words'").first()
    t, c = (all_words.t, all_words.c) if all_words else (0, 0)
    if not t or not c:
        return Model({}, channel, prior, frozenset())
    chosen = _chosen(sums, t / (t + c))
    odds = {r.f: log((r.t + 0.5) / (t + 1)) - log((r.c + 0.5) / (c + 1)) for r in chosen}
    strong = frozenset(r.f for r in chosen if r.strong)
    return _regression(labelled, Model(odds, channel, prior, strong))


def _trigrams(texts: DataFrame) -> DataFrame:
    """g, n: the trigrams of the words of all documents, with two blanks before a word and one after it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()
        for b in batches:
            grams.update(trigrams([t for t in b.column(0).to_pylist() if t]))
        if grams:
            yield pa.RecordBatch.from_pydict({"g": pa.array(list(grams)), "n": pa.array(list(grams.values()), pa.int64())})

    return texts.select("text").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))


def trigrams(texts: list[str]) -> dict[str, int]:
    """How often each trigram stands in the words of texts, all at once: characters are numbered, a trigram is a number."""
    plain = [t if t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts]
    codes = np.frombuffer("\n".join(plain).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    present, hidden = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    present[codes], hidden[list(_HIDDEN)] = True, True
    if (present & hidden).any():
        codes = codes[~hidden[codes]]
    letters = [chr(c) for c in np.flatnonzero(present).tolist() if _LETTERS.fullmatch(chr(c))]
    number = np.zeros(0x110000, np.int32)
    number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    blank = np.zeros(2, np.int32)  # before the first word and after the last
    ids = np.concatenate((blank, number[codes], blank)).astype(np.int64 if len(letters) >= 1000 else np.int32)
    two, one, own = ids[:-2], ids[1:-1], ids[2:]
    k = len(letters) + 1
    found = [((two * k + one) * k + own)[one > 0]]  # a word's letters in the middle: what is before and after may be a blank
    found.append(ids[1:][(ids[1:] > 0) & (ids[:-1] == 0)])  # its first letter after two blanks
    keys = np.concatenate(found)
    if k**3 <= 1 << 24:
        counts = np.bincount(keys, minlength=1)
        keys = np.flatnonzero(counts)
        counts = counts[keys]
    else:
        keys, counts = np.unique(keys, return_counts=True)
    names = [" ", *letters]
    return {names[g // (k * k)] + names[g // k % k] + names[g % k]: n for g, n in zip(keys.tolist(), counts.tolist(), strict=True)}


_COUNTS = "t long, c long, mt long, mc long"


def _summed(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_or("mt").alias("mt"), F.bit_or("mc").alias("mc"))


def _batch(name: str, rows: list[tuple]) -> pa.RecordBatch:
    key, *numbers = zip(*rows, strict=True) if rows else [()] * 5
    return pa.RecordBatch.from_pydict({name: pa.array(key, pa.string()), **{k: pa.array(v, pa.int64()) for k, v in zip(("t", "c", "mt", "mc"), numbers, strict=True)}})


def _words(labelled: DataFrame) -> DataFrame:
    """w, t, c, mt, mc: toxic and other documents that hold a word, and hashed sets of the words before it in either; #docs counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = int(y > 0)
                words: dict[str, int] = {"#docs": 0}
                before = 0
                for raw in (text or "").split():
                    words[raw] = words.get(raw, 0) | 1 << before
                    before = zlib.crc32(raw.encode("utf-8", "replace")) % 63
                for x, mask in words.items():
                    s = seen[x]
                    s[1 - y] += 1
                    s[3 - y] |= mask
                if len(seen) > COUNTED:  # sums are added up after the shuffle
                    yield _batch("w", [(x, *s) for x, s in seen.items()])
                    seen.clear()
        yield _batch("w", [(x, *s) for x, s in seen.items()])

    return _summed(labelled.repartition(PARTS).mapInArrow(count, "w string, " + _COUNTS), "w")


def _counts(words: DataFrame) -> DataFrame:
    """f, t, c, mt, mc of each feature: the sums of the words that hold it; #words has those of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for b in batches:
            for w, t, c, mt, mc in zip(*(x.to_pylist() for x in b.columns), strict=True):
                for x in ("#words", *features(clean(w))):
                    s = seen[x]
                    s[0] += t
                    s[1] += c
                    s[2] |= mt
                    s[3] |= mc
                if len(seen) > COUNTED:
                    yield _batch("f", [(x, *s) for x, s in seen.items()])
                    seen.clear()
        yield _batch("f", [(x, *s) for x, s in seen.items()])

    sums = _summed(words.where("w <> '#docs'").mapInArrow(count, "f string, " + _COUNTS), "f")
    return sums.where((F.col("f") == "#words") | (F.greatest(F.bit_count("mt"), F.bit_count("mc")) >= CONTEXTS))


def _chosen(sums: DataFrame, base: float) -> list:
    """f, t, c, strong of the features whose share of toxic documents differs from the base share by enough evidence and effect.

    Contexts, not copies, are the evidence: a feature counts for no more documents than it has words before it.
    """
    words = sums.where("f <> '#words'")
    tried = max(words.count(), 1)
    p = F.col("t") / (F.col("t") + F.col("c"))
    up = p > base
    contexts, share = F.when(up, F.bit_count("mt")).otherwise(F.bit_count("mc")), F.when(up, p).otherwise(1 - p)
    sure = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    gain = sure(p) * F.log(sure(p) / base) + (1 - sure(p)) * F.log((1 - sure(p)) / (1 - base))
    evidence = F.when(contexts >= 60, F.col("t") + F.col("c")).otherwise(F.least(F.col("t") + F.col("c"), contexts / share)) * gain
    rated = words.where(contexts >= CONTEXTS).select("f", "t", "c", evidence.alias("evidence"), ((p >= base * EFFECT) | (p <= base / EFFECT)).alias("effect"), (up & (p >= PRECISION) & (evidence >= log(tried / ERROR)) & F.col("f").startswith("^") & (F.length("f") > BEGINNINGS[0])).alias("strong"))
    return rated.where((F.col("evidence") >= EVIDENCE) & F.col("effect")).orderBy(F.desc("evidence"), "f").limit(MAX_FEATURES).collect()


def _regression(labelled: DataFrame, first: Model) -> Model:
    """The model whose weights fit the labelled rows, by Adam and, for the bias, Newton's method; rows reach the driver as the numbers of their features."""
    names = sorted(first.weights)
    number = {x: i for i, x in enumerate(names)}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            held = [np.sort(np.array([number[x] for x in first.found(t)], "<i4")).tobytes() for t in texts]
            yield pa.RecordBatch.from_pydict({"y": b.column(0).cast(pa.int32()), "text": pa.array([xxhash.xxh3_128_digest((t or "").encode("utf-8", "replace")) for t in texts], pa.binary()), "held": pa.array(held, pa.binary())})

    # equal texts are one row
    rows = sorted((r.text, int(r.y > 0), r.held) for r in labelled.repartition(PARTS).mapInArrow(numbers, "y int, text binary, held binary").groupBy("text").agg(F.max("y").alias("y"), F.first("held").alias("held")).collect())
    held = [np.frombuffer(bytes(x), "<i4") for _, _, x in rows]
    y, d, n = np.array([x for _, x, _ in rows], float), len(names), len(rows)
    row, column = np.repeat(np.arange(n), [len(x) for x in held]), np.concatenate([np.zeros(0, "<i4"), *held]).astype(np.int64)
    theta, mean, square, bias = np.zeros(d), np.zeros(d), np.zeros(d), first.prior
    for it in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, theta[column], n) + bias, -30, 30)))
        slope = np.bincount(column, (p - y)[row], d) + PENALTY * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        theta -= 0.05 * (1 - it / (ROUNDS + 10)) * (mean / (1 - 0.9**it)) / (np.sqrt(square / (1 - 0.99**it)) + 1e-8)
        # the bias has no penalty and a curvature of its own
        bias -= float(np.clip((p - y).sum() / max((p * (1 - p)).sum(), 1e-3), -1, 1))
    return Model(dict(zip(names, theta.tolist(), strict=True)), first.channel, bias, first.strong)


def _channel(counts: dict[str, int]) -> Channel:
    two, one = Counter(), Counter()
    for g, n in counts.items():
        two[g[:2]] += n
        one[g[2]] += n
    total = sum(one.values()) or 1
    unigrams = {c: n / total for c, n in one.items()}
    return Channel({g: log((n + 2 * unigrams[g[2]]) / (two[g[:2]] + 2)) for g, n in counts.items()}, {c: log(p) for c, p in unigrams.items()})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, score, predicted for each row of docs; whole texts, null as empty, repeated rows each; other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted outside the held-out fold, applied to every document.

    Null and empty texts have the score of a document without features; a null doc_id is never held out; repeated
    rows are each scored; an empty table gives none.
    """
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic.

    The text is scored beside its row, so no join is needed. A name that clashes is kept as it is.
    """
    model = fit(docs, labels)
    small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, schema)
