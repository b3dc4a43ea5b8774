"""Dense-vector expressions: everything is computed in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector) -> Column:
    """A query vector as a constant array of doubles."""
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: each(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def hamming(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))


#: space -> (distance, score of a distance); a larger score is nearer.
_DISTANCE = {
    "l2": (lambda a, b: F.sqrt(l2_squared(a, b)), lambda d: 1 / (1 + d * d)),
    "l1": (l1, lambda d: 1 / (1 + d)),
    "linf": (linf, lambda d: 1 / (1 + d)),
    "hamming": (hamming, lambda d: 1 / (1 + d)),
    "cosinesimil": (lambda a, b: 1 - cosine(a, b), lambda d: (2 - d) / 2),
    "innerproduct": (lambda a, b: -dot(a, b), lambda d: F.when(d <= 0, 1 - d).otherwise(1 / (1 + d))),
}
SPACES = tuple(_DISTANCE)


def distance(a: Column, b: Column, space: str) -> Column:
    return _pick(space)[0](a, b)


def score(a: Column, b: Column, space: str) -> Column:
    """The similarity score of two vectors in a space."""
    to_distance, to_score = _pick(space)
    return to_score(to_distance(a, b))


def _pick(space: str):
    if space not in _DISTANCE:
        raise ValueError(f"unknown space {space!r}; known: {', '.join(SPACES)}")
    return _DISTANCE[space]
