"""Scores of vectors and ranks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Between -1 and 1; 0 if a vector is zero or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Infinite if the lengths differ."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(float("inf")))


def distance_similarity(distance: Column) -> Column:
    return F.when(distance == float("inf"), F.lit(0.0)).otherwise(1 / (1 + distance))


def dense(cos: Column, l2_similarity: Column, alpha: float = 0.5) -> Column:
    """Cosine, moved to 0..1, and distance similarity, mixed."""
    return alpha * (cos + 1) / 2 + (1 - alpha) * l2_similarity


def hybrid(dense_score: Column, lexical: Column, best_lexical: Column, weight: float = 0.35) -> Column:
    """Dense and lexical scores mixed; lexical ones as a share of the pool's best."""
    share = F.when(best_lexical > 0, lexical / best_lexical).otherwise(F.lit(0.0))
    return (1 - weight) * dense_score + weight * share


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (k + rank)


def okapi(tf: Column, df: Column, length: Column, documents: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """A term's BM25 weight in a document."""
    idf = F.log1p((documents - df + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean_length))


def wilson(passed: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a share; null without cases."""
    p = F.try_divide(passed.cast("double"), n.cast("double"))
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))
