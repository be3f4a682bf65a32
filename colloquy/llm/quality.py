"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled covariance and its
diagonal. A document's score comes from the difference of the two Mahalanobis log-densities,
computed with Cholesky factors that are made once on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold, labelled_sample, small_batches

FOLDS, HELD_OUT = 3, 1
#: Labelled documents that a fit reads at most.
FIT_ROWS = 20_000
#: Weights of the pooled covariance and of its diagonal in each class's covariance.
POOLED, DIAGONAL = 0.10, 0.05

_GROUPS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "stop": b".,;:'\"()-",
    "mark": b"!?",
    "symbol": b"#$%&*@^~=+<>[]{}_\\/`",
    "bar": b"|",
    "high": range(128, 256),
}
_CLASSES = np.zeros((256, len(_GROUPS)))
for _i, _g in enumerate(_GROUPS.values()):
    _CLASSES[list(_g), _i] = 1
FEATURES = ("words", "word_length", "distinct", "repeat", "top", "longest", "short", "lines", "line_distinct", "line_length", *_GROUPS)


def _odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: logs of sizes, smoothed log-odds of shares. Null counts as empty."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, raw = len(words), text.encode("utf-8", "replace")
    counts = Counter(words)
    lengths = list(map(len, words))
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(lengths) / n if n else 0)),
        _odds(len(counts), n),
        _odds(sum(map(eq, words, words[1:])), max(n - 1, 0)),
        _odds(max(counts.values(), default=0), n),
        float(np.log1p(max(lengths, default=0))),
        _odds(sum(x <= 3 for x in lengths), n),
        float(np.log1p(len(lines))),
        _odds(len(set(lines)), len(lines)),
        float(np.log1p(len(text) / len(lines) if lines else 0)),
        *(_odds(x, len(raw)) for x in bytes_of),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class 0 and 1: mean, inverse Cholesky factor, log-density constant with the log prior."""

    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability-like scores; the log-density difference is divided by the number of statistics, so few saturate."""
        logs = [c - 0.5 * np.square((x - m) @ inv.T).sum(1) for m, inv, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / x.shape[1], -500, 500)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], d: int) -> Discriminant:
    """From each class's count, sum and sum of outer products. A class without rows takes the pooled moments."""
    n_all = max(sum(m[0] for m in moments.values()), 1)
    centred = {}
    for y in (0, 1):
        n, s, ss = moments.get(y, (0, np.zeros(d), np.zeros((d, d))))
        mean = s / n if n else sum((m[1] for m in moments.values()), np.zeros(d)) / n_all
        centred[y] = (n, mean, ss / n - np.outer(mean, mean) if n else np.zeros((d, d)))
    pooled = sum(n * c for n, _, c in centred.values()) / n_all
    means, inverses, constants = [], [], []
    for n, mean, cov in (centred[0], centred[1]):
        own = cov if n else pooled
        shrunk = (1 - POOLED - DIAGONAL) * own + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        means.append(mean)
        inverses.append(np.linalg.inv(lower))
        constants.append(np.log((n + 1) / (n_all + 2)) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array(means), np.array(inverses), np.array(constants))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, bound: int = FIT_ROWS) -> Discriminant:
    """Moments over at most `bound` labelled documents, summed where the rows lie; only sums reach the driver.

    With no labelled rows at all, both classes are alike and every score is 0.5.
    """
    d = len(FEATURES)
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, target, folds, held_out, bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array([1.0, *statistics(text)])
                total[y] = total.get(y, 0) + np.outer(x, x)
        for y, m in total.items():
            yield pa.RecordBatch.from_pydict({"y": pa.array([y] * m.size, pa.int32()), "at": pa.array(range(m.size), pa.int32()), "v": pa.array(m.ravel())})

    got = rows.mapInArrow(sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    full = {y: np.zeros((d + 1) ** 2) for y in (0, 1)}
    for y, at, v in got:
        if y in full:
            full[y][at] = v
    squares = {y: m.reshape(d + 1, d + 1) for y, m in full.items()}
    return discriminant({y: (m[0, 0], m[0, 1:], m[1:, 1:]) for y, m in squares.items() if m[0, 0]}, d)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """Columns doc_id, score, predicted for each row of docs.

    Null texts count as empty; repeated rows are each scored; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.scores(np.array([statistics(t) for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted outside the held-out fold, applied to every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
