"""Arrays as vectors: norms, cosines, histogram distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in DOUBLE, in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The vector scaled to length 1; a zero one stays zero."""
    return let(a, lambda v: let(F.greatest(norm(v), F.lit(1e-9)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hellinger(a: Column, b: Column) -> Column:
    """Hellinger distance of two histograms that sum to 1."""
    root = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(1 - root, F.lit(0.0)))


def two_part_distance(a: Column, b: Column, half: int, weight: float = 0.3) -> Column:
    """Hellinger distance of the upper half times ``weight`` plus that of the lower times the rest; 0.5 if one is missing."""
    parts = [hellinger(F.slice(a, s, half), F.slice(b, s, half)) for s in (1, half + 1)]
    return F.coalesce(weight * parts[0] + (1 - weight) * parts[1], F.lit(0.5))


def quantise(a: Column) -> Column:
    return F.transform(a, lambda x: F.rint(x * 255).cast("smallint"))


def dequantise(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / 255)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
