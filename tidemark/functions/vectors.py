"""Distances, recall and text form of vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.lit(1.0) - dot(a, b) / size)


def hits(truth: Column, returned: Column) -> Column:
    """Keys in both lists, each counted once."""
    return F.size(F.array_intersect(truth, returned))


def recall_at_k(truth: Column, returned: Column, k: int) -> Column:
    """Hits over k: a short answer's missing keys count as misses."""
    if k < 1:
        raise ValueError("k must be >= 1")
    return hits(truth, returned) / F.lit(float(k))


def vector_text(a: Column) -> Column:
    """[x,y,...] with nine significant digits."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.9g", x.cast("double"))), ","), F.lit("]"))
