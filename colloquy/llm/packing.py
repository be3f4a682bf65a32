"""Lexical retrieval packing: fixed windows filled with documents that share rare tokens.

A task turns its documents into token ids and deals them into shards of bounded size. Each shard has a
BM25 inverted index. The first unused document is the seed of a window; the index returns unused
neighbours for it, best first, and they fill the window. What no longer fits is cut, and the rest is the
next seed, so windows are full. A shard's last tokens go into windows whose lengths are powers of two.
Nothing is shuffled: a shard never spans tasks.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

WINDOW, END = 2048, 1
#: A shard holds so many documents or tokens at most, unless one document has more.
SHARD_DOCS, SHARD_TOKENS = 2048, 1_000_000
K1, B = 1.2, 0.75
#: Terms in more than this fraction of a shard's documents have their weights in a matrix.
DENSE = 16
#: Words that a worker keeps.
CACHE_WORDS = 800_000

# the mark first, so that the search is for marks; what stands before it is looked at only there
#: White space to Python, but not to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MARK = re.compile(r"([.,;:!?])(?<=[^\W\d_].)(?=\s|\Z)")


def _narrow(text: str) -> bool:
    """Whether all characters are of Latin-1, whose lower case is one character each."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Slots(dict):
    """The number of each word seen; new words wait for their ids."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        got = self[word] = len(self)
        return got


class Encoder:
    """Ids of a tokenizer that drops white space and lower-cases, word by word, with words kept.

    White space always ends a token of such a vocabulary, so a text's ids are those of its words. Texts that
    aren't in composed form, that hold the signs around special tokens, or that hold characters which are white
    space to Python alone go to the tokenizer whole; so do all texts, if the tokenizer is of another kind.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        about = json.loads(self.tokenizer.to_str())
        steps = (about["normalizer"] or {}).get("normalizers", [])
        #: Whether white space is dropped, letters are lower-cased, and a word's last token is marked.
        self.by_word = about["model"].get("end_of_word_suffix") == "</w>" and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"}
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.flat, self.held = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _put(self, slots: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.held + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.held : self.held + len(ids)] = ids
        self.start[slots] = self.held + np.cumsum(sizes) - sizes
        self.size[slots] = sizes
        self.held += len(ids)

    def _learn(self) -> None:
        """Ids of the words that wait: plain ones many to a text, told apart by the token that ends each; others one by one."""
        words, self.slots.new = self.slots.new, []
        if not words:
            return
        while len(self.slots) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        first = len(self.slots) - len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() and _narrow(w)]
        whole = set(plain)
        odd = [i for i in range(len(words)) if i not in whole]
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                self._put(first + np.array(group), ids, np.diff(ends, prepend=0))
            else:
                odd += group
        if odd:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)]
            self._put(first + np.array(odd), np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.slots) > CACHE_WORDS:
            self._clear()
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, numbers, counts = [], [], []
        for i, text in enumerate(texts):
            if not self.by_word or "<|" in text or _SEPARATORS.search(text) or not text.isascii() and not unicodedata.is_normalized("NFC", text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            # a mark after a letter is a token of its own; so are words in lower case, where that has one form
            words = (_MARK.sub(r" \1", text.lower()) if _narrow(text) else text).split()
            plain.append(i)
            counts.append(len(words))
            numbers.append(np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words)))
        if plain:
            self._learn()
            slots = np.concatenate(numbers)
            sizes = self.size[slots]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(self.start[slots] - ends + sizes, sizes) + np.arange(total)]
            upto = np.concatenate(([0], ends))[np.cumsum(counts)]
            for i, part in zip(plain, np.split(ids, upto[:-1]), strict=True):
                out[i] = part
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Kept for a worker's life, so later tasks know the words."""
    return Encoder(path)


class Index:
    """BM25 over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        self.n = n = len(docs)
        sizes = np.array([len(d) for d in docs])
        terms = np.concatenate(docs).astype(np.int64)
        pairs, tf = np.unique(np.repeat(np.arange(n), sizes) << 32 | terms, return_counts=True)
        doc, term = pairs >> 32, pairs & 0xFFFFFFFF
        vocabulary, term, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        tf = tf.astype(np.float64)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / sizes.mean()))).astype(np.float32)
        self.term, self.rows = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.posting_docs, self.posting_weights = doc[order], self.weight[order]
        self.heads = np.concatenate(([0], np.cumsum(df)))
        self.df = df
        # long posting lists are rows of a matrix: sums of whole rows take no places to look up
        common = np.flatnonzero((df > n // DENSE) & (df > 1))
        self.dense = np.full(len(df), -1)
        self.dense[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n), np.float32)
        at = self.dense[self.term]
        self.matrix[at[at >= 0], doc[at >= 0]] = self.weight[at >= 0]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with the seed, best first, ties by order."""
        a, b = self.rows[seed], self.rows[seed + 1]
        own = self.term[a:b]
        own = own[self.df[own] > 1]
        if not len(own):
            return own
        at = self.dense[own]
        asked = np.zeros(len(self.matrix), np.float32)
        asked[at[at >= 0]] = 1
        scores = (asked @ self.matrix).astype(np.float64)
        slices = [slice(self.heads[t], self.heads[t + 1]) for t in own[at < 0]]
        if slices:
            scores += np.bincount(np.concatenate([self.posting_docs[s] for s in slices]), np.concatenate([self.posting_weights[s] for s in slices]), self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Windows, each a list of (document, start, length); every id of every document lies in one piece."""
    index, n = Index(docs), len(docs)
    used = np.zeros(n, bool)
    row: list[tuple[int, int, int]] = []
    room, following = window, 0
    queue: list[int] = []
    seed = -1
    while True:
        if not queue and seed >= 0 and row:
            queue = index.neighbours(seed, used).tolist()[::-1]
            seed = -1  # a window asks once; with no neighbours left, documents follow in order
        if queue:
            doc = queue.pop()
            if used[doc]:
                continue
        else:
            while following < n and used[following]:
                following += 1
            if following == n:
                break
            doc = following
        used[doc] = True
        at, size = 0, len(docs[doc])
        if not row:
            seed = doc
        while size - at >= room:
            row.append((doc, at, room))
            yield row
            at += room
            row, room, queue, seed = [], window, [], doc
        if at < size:
            row.append((doc, at, size - at))
            room -= size - at
    # the rest: powers of two need no padding
    while row:
        part = 1 << ((window - room).bit_length() - 1)
        out, left = [], part
        while left:
            doc, at, size = row[0]
            take = min(size, left)
            out.append((doc, at, take))
            left -= take
            row = [(doc, at + take, size - take), *row[1:]] if take < size else row[1:]
        room += part
        yield out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, input_ids.

    A document is the ids of its text, then END; null texts count as empty, so each row has one id at least.
    Repeated rows are each packed. sequence_id is the task's number times 2**32 plus the window's number there.
    An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, base, made = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        names_of: list[int | None] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held
            rows: list[tuple] = []
            lists: list[np.ndarray] = []
            for pieces in pack_shard(ids, window):
                offset = 0
                for d, at, size in pieces:
                    part = ids[d][at : at + size].astype("<u4")
                    rows.append((names_of[d], at, size, zlib.crc32(part.tobytes()), len(ids[d]), base + made, offset))
                    if with_ids:
                        lists.append(part.view(np.int32))
                    offset += size
                made += 1
                if len(rows) >= 4096:
                    yield batch(rows, lists)
                    rows, lists = [], []
            if rows:
                yield batch(rows, lists)
            ids.clear()
            names_of.clear()
            held = 0

        def batch(rows: list[tuple], lists: list[np.ndarray]) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if with_ids:
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists))))
            return pa.RecordBatch.from_arrays(cols, names + ["input_ids"] * with_ids)

        for b in batches:
            for doc_id, found in zip(b.column(0).to_pylist(), e.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                own = np.append(found, np.uint32(END))
                ids.append(own)
                names_of.append(doc_id)
                held += len(own)
                if held >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                    yield from flush()
        if ids:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names) + (", input_ids array<int>" if with_ids else ""))
