"""Exact nearest neighbours of stated queries: filter, distance, top-k.

Every order ends with the id, so that ties have one answer.  Rows whose vector is null or of
another length than the query have no distance and never come out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.vectors import METRICS, l2_pair, pad

DEFAULT_LIMIT = 10


def with_score(df: DataFrame, query: Sequence[float], vector: str = "vector", metric: str = "l2") -> DataFrame:
    """Rows whose vector has the query's length, with their distance (null if the vector holds nulls or has no direction)."""
    return df.filter(F.size(vector) == len(query)).withColumn("score", METRICS[metric](F.col(vector), query))


def knn(
    df: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_LIMIT,
    where: Column | str | None = None,
    id_col: str = "chunk_id",
    vector: str = "vector",
    metric: str = "l2",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The ``k`` rows nearest to ``query`` among those that pass ``where`` (filter first).

    ``k`` <= 0 means ten.  The vector is left out of the result, so the sort moves no vectors.
    """
    if where is not None:
        df = df.filter(where)
    keep = list(columns) if columns else [c for c in df.columns if c != vector]
    scored = with_score(df, query, vector, metric).select(*dict.fromkeys([*keep, id_col, "score"]))
    # distances without a value sort last and are dropped behind the limit: a filter before it would work every distance out twice
    return scored.orderBy(F.col("score").asc_nulls_last(), id_col).limit(k if k > 0 else DEFAULT_LIMIT).filter(F.col("score").isNotNull())


def knn_batch(
    df: DataFrame,
    queries: Sequence[tuple[int, Sequence[float]]],
    k: int = DEFAULT_LIMIT,
    id_col: str = "chunk_id",
    vector: str = "vector",
) -> DataFrame:
    """The ``k`` nearest rows of each of a short stated list of queries, in one pass over ``df``.

    Queries are literals of the plan; each row is scored against all of them where it lies and only
    (query, id, score) is ranked, with Spark's partial per-group limit before the shuffle.
    """
    qs = F.array(*[F.struct(F.lit(i).alias("query_id"), F.array(*[F.lit(float(x)) for x in q]).alias("q")) for i, q in queries])
    scored = df.select(F.col(id_col), F.explode(F.transform(
        qs, lambda s: F.struct(s["query_id"].alias("query_id"), F.when(F.size(vector) == F.size(s["q"]), l2_pair(F.col(vector), s["q"])).alias("score"))
    )).alias("hit")).select(id_col, "hit.query_id", "hit.score").filter(F.col("score").isNotNull())
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    return scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def lookup_vector(df: DataFrame, key, id_col: str = "chunk_id", vector: str = "vector") -> list[float] | None:
    """The vector of one row (a point lookup; one row reaches the driver)."""
    row = df.filter(F.col(id_col) == F.lit(key)).select(vector).filter(F.col(vector).isNotNull()).limit(1).first()
    return list(row[0]) if row else None


def lookup_vectors(df: DataFrame, keys: Sequence, id_col: str = "chunk_id", vector: str = "vector") -> list[tuple]:
    """(key, vector) of a short stated list of rows, in order of the key: one pass."""
    rows = df.filter(F.col(id_col).isin(list(keys)) & F.col(vector).isNotNull()).select(id_col, vector).collect()
    return [(k, list(v)) for k, v in sorted({r[0]: r[1] for r in rows}.items())]


def recommend(
    df: DataFrame, key, k: int = 5, where: Column | str | None = None, id_col: str = "chunk_id", vector: str = "vector"
) -> DataFrame:
    """Rows most like a given row, without itself. An unknown key or a null vector gives no row."""
    q = lookup_vector(df, key, id_col, vector)
    others = df.filter(F.col(id_col) != F.lit(key))
    if q is None:
        return others.drop(vector).withColumn("score", F.lit(None).cast("double")).limit(0)
    return knn(others, q, k, where, id_col, vector)


def pad_query(query: Sequence[float], dim: int) -> list[float]:
    """The driver-side twin of :func:`sextant.functions.vectors.pad` for one query."""
    q = [float(x) for x in query][:dim]
    return q + [0.0] * (dim - len(q))


__all__ = ["knn", "knn_batch", "lookup_vector", "lookup_vectors", "pad", "pad_query", "recommend", "with_score"]
