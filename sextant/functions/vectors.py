"""Vector expressions. Stored values are float32, arithmetic is in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this length a distance is written out as one sum inside whole-stage codegen. For longer vectors compiling such a
#: sum costs more (1.4 s for 64 terms) than it saves (0.2 s over 300,000 rows, as measured), and from some hundred
#: terms on the method is too large for the JVM: higher-order functions serve there.
UNROLL_LIMIT = 16


def _sum(terms: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return total


def _literal(q: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def _dot(v: Column, q: Sequence[float]) -> Column:
    if len(q) <= UNROLL_LIMIT:
        return _sum([F.get(v, F.lit(j)).cast("double") * F.lit(float(x)) for j, x in enumerate(q)])
    return F.aggregate(F.zip_with(v, _literal(q), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column, q: Sequence[float]) -> Column:
    """Squared Euclidean distance to a fixed query vector."""
    if len(q) <= UNROLL_LIMIT:
        d = [F.get(v, F.lit(j)).cast("double") - F.lit(float(x)) for j, x in enumerate(q)]
        return _sum([x * x for x in d])
    return l2_pair(v, _literal(q))


def l2_pair(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vector columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(v: Column, q: Sequence[float]) -> Column:
    """1 - cosine similarity; null where a vector has no length."""
    qn = sum(float(x) * float(x) for x in q) ** 0.5
    size = norm(v) * F.lit(qn)
    return F.when(size > 0, F.lit(1.0) - _dot(v, q) / size)


def dot(v: Column, q: Sequence[float]) -> Column:
    """Negative inner product, so that lower is better here too."""
    return -_dot(v, q)


METRICS = {"l2": l2, "cosine": cosine, "dot": dot}


def distance(metric: str, v: Column, q: Sequence[float]) -> Column:
    """Distance to a fixed query; null where the vector is null or of another length."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    return F.when(F.size(v) == len(q), METRICS[metric](v, q))


def normalise(v: Column) -> Column:
    """Unit length; a vector without length stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def pad(v: Column, dim: int) -> Column:
    """Zero-padded to ``dim`` and narrowed to float32; a longer vector is cut (queries only)."""
    return F.slice(F.concat(v.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def checked(v: Column, dim: int) -> Column:
    """As :func:`pad`, but a stored vector longer than ``dim`` is an error."""
    too_long = F.raise_error(F.concat(F.lit(f"vector longer than {dim}: "), F.size(v).cast("string"))).cast("array<float>")
    return F.when(F.size(v) > dim, too_long).otherwise(pad(v, dim))
