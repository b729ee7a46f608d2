"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as zero.
LEAST_NORM = 1e-12


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; null where it has no direction. The norm is computed once for a vector, not for each component."""
    return F.transform(F.array(norm(v)), lambda n: F.when((n >= LEAST_NORM) & ~F.isnan(n) & (n < float("inf")), F.transform(v, lambda x: x / n)))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance3(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def short_link(distance: Column, limit: float, scale: float) -> Column:
    return distance <= limit * scale + 1e-6


def topic_target(similarity: Column, density: float) -> Column:
    """Wanted distance of two topics: far for unlike ones, nearer at a higher density."""
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity))
    return 225 * (0.075 + F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * clamped))) * (1 - 0.4 * density)


def memory_estimate(n: Column, d: Column, width: int, k: int, payload: int) -> dict[str, Column]:
    """Bytes of a dense similarity matrix, of the vectors, and of a sparse neighbour graph."""
    return {"dense_bytes": n * n * 4, "vector_bytes": n * d * width, "sparse_bytes": n * k * (4 + payload) + (n + 1) * 4}
