"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table, made from templates with a fixed seed, and decoded by
Viterbi over numpy batches of lines. A word's shape is a 16-bit code (counts of digits, capitals, dots
and so on), so the scores of every possible shape are one table.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "card+", "phone", "phone+")  # + continues a span
TRAIN_ROWS, SEED = 800, 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can't begin within a run of digits: none would end otherwise
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with what stands before it since the last match, and a domain."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the exact patterns, by start and then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Word shapes: a 16-bit code from counts of the kinds of bytes in a word.

_LANES = ("digit", "upper", "lower", "at", "dot", "dash", "paren", "other")
_LANE = np.full(256, 7, np.int64)
_LANE[48:58], _LANE[65:91], _LANE[97:123], _LANE[128:] = 0, 1, 2, 2
_LANE[[64, 46, 45, 40, 41]] = [3, 4, 5, 6, 6]
_PACKED = np.left_shift(np.uint64(1), (8 * _LANE).astype(np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_DIGIT_BIN = np.searchsorted([0, 1, 2, 3, 6, 9, 12, 19], np.arange(256), "left")  # 0 1 2 3 4-6 7-9 10-12 13-19 more
#: Bits of the code and how many values each part has: digits, capitals, lower case, @, dots, dashes, brackets, others, leading +.
_SHIFTS, _SIZES = (0, 4, 6, 7, 8, 11, 13, 14, 15), (9, 3, 2, 2, 5, 4, 2, 2, 2)
#: Words of more bytes are counted one by one: a lane of the packed counts holds less than 256.
_LANE_FULL = 255


def codes_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape code of each word of a UTF-8 buffer."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lanes = np.add.reduceat(_PACKED[raw] * ~_SPACE[raw], starts)
    n = [(lanes >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64) for i in range(8)]
    for w in np.flatnonzero(ends - starts > _LANE_FULL).tolist():
        for lane, k in enumerate(np.bincount(_LANE[raw[starts[w] : ends[w]]], minlength=8).tolist()):
            n[lane][w] = min(k, _LANE_FULL)
    first = raw[starts]
    code = _DIGIT_BIN[n[0]] | np.minimum(n[1], 2) << 4 | (n[2] > 0) << 6 | (n[3] > 0) << 7 | np.minimum(n[4], 4) << 8
    return code | np.minimum(n[5], 3) << 11 | (n[6] > 0) << 13 | (n[7] > 0) << 14 | (first == 43) << 15


def _features() -> np.ndarray:
    """For each code, the numbers of its features: each part's value, and three pairs of parts."""
    code = np.arange(1 << 16)
    parts = [np.minimum(code >> s & (1 << (b - s)) - 1, k - 1) for s, b, k in zip(_SHIFTS, (*_SHIFTS[1:], 16), _SIZES, strict=True)]
    parts += [parts[0] * 5 + parts[4], parts[0] * 4 + parts[5], parts[3] * 5 + parts[4], parts[0] * 2 + parts[6], parts[0] * 2 + parts[2]]
    sizes = [*_SIZES, 45, 36, 10, 18, 18]
    return np.stack([p + o for p, o in zip(parts, np.cumsum([0, *sizes[:-1]]), strict=True)], 1)


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    solid = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def training_table(rows: int = TRAIN_ROWS, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    """Labelled lines: plain words, numbers that are no personal data, and the four kinds in several spellings."""
    rng = random.Random(seed)
    pick, digits = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syllables = "an be con de er ga ing lo mi on que re sch ti un vo wa é ü ñ".split()
    code = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 5)))
    part = lambda: str(rng.randint(0, 255))
    end = lambda: pick(["", "", "", ".", ",", ";", ")"])

    def plain() -> list[tuple[str, str]]:
        w = word()
        kinds = [w, w, w, w.capitalize(), w.upper(), w + pick(".,;:!?"), w + "!!", "|", digits(rng.randint(1, 4)), digits(2) + "%", f"{digits(1)}.{digits(1)}{end()}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"({digits(4)})", f"({w})", f"{w}-{word()}", f"http://{w}.{word()}/{word()}", f"{w}.{word()}", f"{digits(3)},{digits(3)}", f"#{digits(3)}", f"{w}{digits(2)}", f"@{w}", f"{w}={digits(8)}{w}", f"${digits(3)}.{digits(2)}", f"{w}***", f"{digits(5)}", *(f"{w}={code(18)}", f'"{code(40)}"', code(24), "AKIA" + code(16).upper()) * 2]
        return [(pick(kinds if rng.random() < 0.4 else kinds[:6]), "O")]

    def email() -> list[tuple[str, str]]:
        local = pick([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}+{word()}"])
        return [(pick(["", "", "<", "("]) + f"{local}@{pick([word(), 'mail' + digits(1)])}.{pick(['com', 'org', 'example.com', 'co.uk'])}" + end(), "email")]

    def ip() -> list[tuple[str, str]]:
        return [(".".join(part() for _ in range(4)) + pick(["", "", "", ",", ".", ":8080"]), "ip")]

    def spread(words: list[str], kind: str) -> list[tuple[str, str]]:
        words[-1] += end()
        return [(w, kind if i == 0 else kind + "+") for i, w in enumerate(words)]

    def card() -> list[tuple[str, str]]:
        groups = pick([[4, 4, 4, 4], [4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 3]])
        d = [digits(n) for n in groups]
        return spread(pick([["".join(d)], ["-".join(d)], d]), "card")

    def phone() -> list[tuple[str, str]]:
        a, b, c, cc = digits(3), digits(3), digits(4), "+" + pick(["1", "44", "49", "33", "34"])
        return spread(pick([[cc, f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"({a}){b}-{c}"], [f"{a}-{b}-{c}"], [f"{cc}-{a}-{b}-{c}"], [f"{cc}{a}{b}{c}"], [cc, a, b, c], [cc, f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [cc, a, b + c]]), "phone")

    out = []
    for _ in range(rows):
        line: list[tuple[str, str]] = []
        for _ in range(rng.randint(2, 7)):
            line += plain()
            if rng.random() < 0.22:
                line += pick([email, ip, card, phone])()
        out.append(([w for w, _ in line], [y for _, y in line]))
    return out


class Field:
    """Scores of shapes (word itself, before, after) and of label pairs."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps  # 3 x features x labels; label x label
        self.tables = weights[:, _features()].sum(2).astype(np.float32)  # 3 x codes x labels
        gain = steps - steps[0, 0]
        self.gain = 2 * max(0.0, float(gain.max()))

    def emissions(self, codes: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Label scores of each word; words see their neighbours in the same line only."""
        e = self.tables[0][codes]
        if len(codes) > 1:
            same = (line[1:] == line[:-1])[:, None]
            e[1:] += self.tables[1][codes[:-1]] * same
            e[:-1] += self.tables[2][codes[1:]] * same
        return e

    def decode(self, codes: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The Viterbi label of each word; line: ascending line numbers.

        Where no word of a line could gain from another label than O, whatever its neighbours, all-O is the
        best path and needs no search.
        """
        out = np.zeros(len(codes), np.int8)
        if not len(codes):
            return out
        e = self.emissions(codes, line)
        open_ = (e[:, 1:].max(1) - e[:, 0] + self.gain) >= 0
        if not open_.any():
            return out
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(codes)])))
        wanted = np.flatnonzero(np.logical_or.reduceat(open_, starts))
        wanted = wanted[np.argsort(sizes[wanted], kind="stable")]
        at = 0
        while at < len(wanted):  # lines of like lengths together, 400,000 cells at most unless one line has more
            upto = at + 1
            while upto < len(wanted) and (upto + 1 - at) * sizes[wanted[upto]] <= 400_000 and sizes[wanted[upto]] <= 2 * sizes[wanted[at]] + 8:
                upto += 1
            group = wanted[at:upto]
            self._viterbi(e, starts[group], sizes[group], out)
            at = upto
        return out

    def _viterbi(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        # lines are ordered by length: at step t only the last ones are still open
        n, longest = len(starts), int(sizes[-1])
        back = np.zeros((longest, n, len(LABELS)), np.int8)
        v = e[starts] + self._first()
        firsts = np.searchsorted(sizes, np.arange(longest), "right")
        for t in range(1, longest):
            k = firsts[t]
            moved = v[k:, :, None] + self.steps
            back[t, k:] = moved.argmax(1)
            v[k:] = moved.max(1) + e[starts[k:] + t]
        label = v.argmax(1)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            k = firsts[t]
            out[starts[k:] + t] = label[k:]
            if t:
                label[k:] = back[t, rows[k:], label[k:]]

    @staticmethod
    def _first() -> np.ndarray:
        return np.array([-1e4 if x.endswith("+") else 0 for x in LABELS], np.float32)


_ALLOWED = np.array([[0.0 if not b.endswith("+") or a.rstrip("+") == b.rstrip("+") else -1e4 for b in LABELS] for a in LABELS])


def train(table: list[tuple[list[str], list[str]]] | None = None, rounds: int = 100) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam; forward and backward run over all lines at once."""
    table = table or training_table()
    index, phi, k = {y: i for i, y in enumerate(LABELS)}, _features(), len(LABELS)
    longest, n, d = max(len(w) for w, _ in table), len(table), int(_features().max()) + 1
    shape = np.zeros((n, longest, d), np.float32)
    gold, here = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for r, (words, labels) in enumerate(table):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        codes = codes_of(raw, *words_of(raw))
        np.put_along_axis(shape[r, : len(words)], phi[codes], 1, 1)
        gold[r, : len(words)] = [index[y] for y in labels]
        here[r, : len(words)] = True
    # what a word sees: itself, the word before, the word after; nothing beyond its line
    before, after = np.zeros_like(shape), np.zeros_like(shape)
    before[:, 1:], after[:, :-1] = shape[:, :-1], shape[:, 1:]
    seen = np.concatenate((shape, before, after), 2).reshape(n * longest, 3 * d) * here.reshape(-1, 1)
    w, steps = np.zeros((3 * d, k)), np.zeros((k, k))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(steps), np.zeros_like(steps)]]
    first = Field._first()
    for it in range(1, rounds + 1):
        e = (seen @ w.astype(np.float32)).reshape(n, longest, k).astype(np.float64)
        tr = steps + _ALLOWED
        a = np.zeros((n, longest, k))
        a[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            x = a[:, t - 1, :, None] + tr
            m = x.max(1)
            a[:, t] = np.where(here[:, t, None], m + np.log(np.exp(x - m[:, None]).sum(1)) + e[:, t], a[:, t - 1])
        m = a[:, -1].max(1)
        z = m + np.log(np.exp(a[:, -1] - m[:, None]).sum(1))
        b = np.zeros((n, longest, k))
        pair = np.zeros((k, k))
        for t in range(longest - 1, 0, -1):
            x = tr + (e[:, t] + b[:, t])[:, None, :]
            pair += (np.exp(a[:, t - 1, :, None] + x - z[:, None, None]) * here[:, t, None, None]).sum(0)
            m = x.max(2)
            b[:, t - 1] = np.where(here[:, t, None], m + np.log(np.exp(x - m[..., None]).sum(2)), 0)
        p = np.exp(a + b - z[:, None, None]) * here[..., None]
        p[np.arange(n)[:, None], np.arange(longest), gold] -= here
        gw = seen.T @ p.reshape(-1, k).astype(np.float32)
        np.add.at(pair, (gold[:, :-1][here[:, 1:]], gold[:, 1:][here[:, 1:]]), -1)
        for x, g, mom in ((w, gw / n + 2e-4 * w, moments[0]), (steps, pair / n + 2e-4 * steps, moments[1])):
            mom[0][:] = 0.9 * mom[0] + 0.1 * g
            mom[1][:] = 0.98 * mom[1] + 0.02 * g * g
            x -= 0.15 * (mom[0] / (1 - 0.9**it)) / (np.sqrt(mom[1] / (1 - 0.98**it)) + 1e-8)
    return Field(w.reshape(3, d, k).astype(np.float32), (steps + _ALLOWED).astype(np.float32))


@lru_cache(maxsize=2)
def _loaded(weights: bytes, steps: bytes) -> Field:
    k = len(LABELS)
    return Field(np.frombuffer(weights, np.float32).reshape(3, -1, k).copy(), np.frombuffer(steps, np.float32).reshape(k, k).copy())


#: Digits that a span of each kind needs: fewer or more, and the labels are an error.
_DIGITS = {"email": (0, 10**6), "ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
_TRIM = ".,;:!?\"'<>[]{}"


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """start, end, kind (code points) of each text's labelled spans."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    raws = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(raws), np.uint8)
    if not len(raw):
        return out
    starts, ends = words_of(raw)
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, starts)
    labels = field.decode(codes_of(raw, starts, ends), line)
    hits = np.flatnonzero(labels)
    if not len(hits):
        return out
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    doc = np.searchsorted(offsets, starts[hits], "right") - 1
    spans: list[list[int]] = []
    for w, k in zip(hits.tolist(), doc.tolist(), strict=True):
        name = LABELS[labels[w]]
        if name.endswith("+") and spans and spans[-1][1] == w - 1:
            spans[-1][1] = w
        else:
            spans.append([w, w, k])
    at, upto, chars = -1, 0, 0  # a text is decoded once, span by span
    for a, b, k in spans:
        kind = LABELS[labels[a]].rstrip("+")
        lo = int(starts[a] - offsets[k])
        if k != at:
            at, upto, chars = k, 0, 0
        chars += len(raws[k][upto:lo].decode("utf-8", "replace"))
        upto, start = lo, chars
        seen = raws[k][lo : int(ends[b] - offsets[k])].decode("utf-8", "replace")
        cut = seen.lstrip(_TRIM + ("(" if seen.count("(") > seen.count(")") else ""))
        start += len(seen) - len(cut)
        cut = cut.rstrip(_TRIM + (")" if cut.count(")") > cut.count("(") else ""))
        low, high = _DIGITS[kind]
        if cut and low <= len(_DIGIT.findall(cut)) <= high and (kind != "email" or "@" in cut[1:-1]):
            out[k].append((start, start + len(cut), kind))
    return out


def find(field: Field, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """Per text: the exact spans, and all spans: labelled ones that overlap no exact one are added."""
    for text, more in zip(texts, field_spans(field, texts), strict=True):
        base = base_spans(text)
        yield base, sorted(base + apart(more, base), key=lambda s: (s[0], KINDS.index(s[2])))


def apart(spans: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of others: of those that start before a span's end, none may reach past its start."""
    held = sorted(others)
    starts, reach = [b[0] for b in held], [0, *accumulate((b[1] for b in held), max)]
    return [s for s in spans if reach[bisect_left(starts, s[1])] <= s[0]]


def _parts(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Texts together up to so many characters; one longer text alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans for each row of docs.

    Spans are kind:start:end in code points, comma-joined, by start and then kind; counts are of the exact
    ones. Null texts count as empty; repeated rows are each reported; other columns are not read; an empty table
    gives none.
    """
    field = field or train()
    small_batches(docs.sparkSession)
    weights, steps = field.weights.tobytes(), field.steps.tobytes()
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _loaded(weights, steps)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [x for part in _parts(texts) for x in find(f, part)]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([spell(x) for x, _ in got], pa.string()), pa.array([spell(x) for _, x in got], pa.string())], ["doc_id", *names, "base_spans", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_spans string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first names the whole."""
    out, at, joined = [], 0, []
    for a, b, kind in spans:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b, kind])
    for a, b, kind in joined:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of docs, all columns, with every span in text replaced by its kind, and n_chars, if there, made to fit.

    Null stays null and empty empty; repeated rows all stay; an empty table stays empty.
    """
    field = field or train()
    small_batches(docs.sparkSession)
    weights, steps, schema, names = field.weights.tobytes(), field.steps.tobytes(), docs.schema, docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _loaded(weights, steps)
        for b in batches:
            texts = b.column(at).to_pylist()
            plain = [t or "" for t in texts]
            got = [x for part in _parts(plain) for x in find(f, part)]
            new = [None if t is None else masked(t, spans) for t, (_, spans) in zip(texts, got, strict=True)]
            yield b.set_column(at, names[at], pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def digest(spans: str = "base_spans"):
    return F.sha2(F.col(spans), 256)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
