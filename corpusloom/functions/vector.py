"""Vector expressions over arrays, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot_literal(a: Column, values: list[float]) -> Column:
    """Unrolled dot product with a known vector: stays in generated code."""
    total = F.lit(0.0)
    for i, v in enumerate(values):
        total = total + a[i].cast("double") * F.lit(float(v))
    return total


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def score(a: Column, values: list[float], metric: str) -> Column:
    """The larger the nearer: cosine similarity, negative distance or inner product."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric == "ip":
        return dot_literal(a, values)
    if metric == "l2":
        total = F.lit(0.0)
        for i, v in enumerate(values):
            d = a[i].cast("double") - F.lit(float(v))
            total = total + d * d
        return -F.sqrt(total)
    size = sum(v * v for v in values) ** 0.5
    n = norm(a) * F.lit(size)
    return F.when(n > 0, dot_literal(a, values) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
