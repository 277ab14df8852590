"""The declarative query of the table API: columns, predicate, limit and an optional vector search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.knn import knn


@dataclass(frozen=True)
class VectorSearch:
    vector: Sequence[float]
    k: int = 10
    column: str = "vector"
    metric: str = "l2"
    id_col: str = "chunk_id"


@dataclass(frozen=True)
class QuerySpec:
    """With a vector search, ``where`` applies to its k candidates (post-filter) unless ``prefilter`` is set."""

    columns: Sequence[str] = field(default_factory=tuple)
    where: Column | str | None = None
    limit: int | None = None
    offset: int = 0
    order_by: Sequence[str] = field(default_factory=tuple)
    vector_search: VectorSearch | None = None
    prefilter: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        where = F.expr(self.where) if isinstance(self.where, str) else self.where
        order = list(self.order_by)
        if v := self.vector_search:
            df = knn(df, v.vector, v.k, where if self.prefilter else None, v.id_col, v.column, v.metric)
            order = order or ["score", v.id_col]
        if where is not None and not (self.vector_search and self.prefilter):
            df = df.filter(where)
        if order and (self.limit is not None or self.offset):
            df = df.orderBy(*order)
        if self.offset:
            df = df.offset(self.offset)
        if self.limit is not None:
            df = df.limit(self.limit)
        if self.columns:
            extra = ["score"] if self.vector_search and "score" not in self.columns else []
            df = df.select(*self.columns, *extra)
        return df


def select(df: DataFrame, spec: QuerySpec) -> DataFrame:
    return spec.apply(df)


def select_with_filter(df: DataFrame, where: str) -> DataFrame:
    return QuerySpec(where=where).apply(df)


def select_with_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return QuerySpec(columns=columns).apply(df)


def select_with_limit(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    return QuerySpec(order_by=[key], limit=limit, offset=offset).apply(df)
