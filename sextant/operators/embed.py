"""Embedding of texts: once per distinct text, batched, behind a small protocol.

The HTTP call and the deterministic stand-in are both ``Embedder`` objects.  Rows with a null text
get a null vector.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import code_points, content_hash
from sextant.functions.vectors import checked

DIM = 3584  # Fixed value: the stored vector length.


class Embedder(Protocol):
    def embed_many(self, texts: list[str]) -> list[list[float]]: ...


class HttpEmbedder:
    """An OpenAI-style ``/v1/embeddings`` service; three attempts, with one and two seconds between them."""

    def __init__(self, endpoint: str, model: str, api_key: str = "", waits: tuple[float, ...] = (1.0, 2.0), timeout: float = 60.0):
        self.url = endpoint.removesuffix("/").removesuffix("/v1") + "/v1/embeddings"
        self.model, self.api_key, self.waits, self.timeout = model, api_key, waits, timeout

    def _post(self, texts: list[str]) -> list[dict]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as r:
            if r.status != 200:
                raise RuntimeError(f"status {r.status}")
            data = json.load(r).get("data") or []
        if not data:
            raise RuntimeError("the service returned no embedding")
        return data

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        for wait in (*self.waits, None):
            try:
                data = self._post(texts)
                break
            except Exception:
                if wait is None:
                    raise
                time.sleep(wait)
        if len(data) != len(texts):
            raise ValueError(f"{len(texts)} texts, {len(data)} embeddings")
        if all("index" in d for d in data):
            data = sorted(data, key=lambda d: d["index"])
        return [d["embedding"] for d in data]


class LengthEmbedder:
    """Deterministic stand-in: byte length and sum of code points, each plus an offset."""

    def __init__(self, offset: int = 1):
        self.offset = offset

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t.encode()) + self.offset), float(sum(map(ord, t)) + self.offset)] for t in texts]


def query_embedder(embedder: Embedder, size: int = 1024):
    """Embeds single queries with a cache on the driver."""
    return lru_cache(maxsize=size)(lambda text: tuple(embedder.embed_many([text])[0]))


def length_vector(text, offset: int = 1):
    """The stand-in as a Column: no Python."""
    return F.array(
        (F.octet_length(text) + F.lit(offset)).cast("float"), (code_points(text) + F.lit(offset)).cast("float")
    )


def embed_distinct(df: DataFrame, embedder: Embedder, text: str = "code", dim: int = DIM, batch: int = 8, workers: int = 10) -> DataFrame:
    """``df`` with a column ``vector``; each distinct text is embedded once.

    Texts are hashed, one row per hash goes to the service in batches over ``workers`` partitions,
    and vectors are joined back by hash.
    """
    if "vector" in df.columns:
        df = df.drop("vector")
    keyed = df.withColumn("__h", content_hash(F.col(text)))
    unique = keyed.filter(F.col(text).isNotNull()).select("__h", F.col(text).alias("__t")).dropDuplicates(["__h"])

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts, vectors = p["__t"].tolist(), []
            for i in range(0, len(texts), batch):
                vectors += embedder.embed_many(texts[i : i + batch])
            yield pd.DataFrame({"__h": p["__h"], "vector": vectors})

    made = unique.repartition(workers, "__h").mapInPandas(call, "__h string, vector array<float>")
    return keyed.join(made, "__h", "left").drop("__h").withColumn("vector", checked(F.col("vector"), dim))


def embed_two_passes(df: DataFrame, code: Embedder, docs: Embedder, **args) -> DataFrame:
    """Code and docs each by their own model, deduplicated within each pass."""
    a = embed_distinct(df.filter(F.col("embedding_type") == "code"), code, **args)
    b = embed_distinct(df.filter(F.col("embedding_type") == "docs"), docs, **args)
    return a.unionByName(b)


def dedup_stats(df: DataFrame, text: str = "code") -> DataFrame:
    """One row: rows with a text, distinct texts, duplicates."""
    per = df.filter(F.col(text).isNotNull()).groupBy(content_hash(F.col(text)).alias("h")).agg(F.count("*").alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("*").alias("unique_rows"))
    return out.withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_rows"))
