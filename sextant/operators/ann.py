"""Approximate search by stored indexes: IVF-Flat, IVF-PQ and LSH.

An index is a Parquet table below a folder, written once and read by every search: vectors partitioned by cell (IVF), or ids sorted by
table and bucket (LSH).  Centres, code books and hyperplanes are fitted on at most ``FIT_ROWS`` rows chosen by hash, on the driver; every row is indexed,
where it lies.  How many cells or buckets a query visits, and how many candidates are compared exactly, is calibrated on held-out rows of that sample to the wanted recall.

Queries come as a frame (query_id, q). Each is sent to its cells or buckets by a join, so Spark reads only the partitions that a query asks for.

Defined results: rows whose id or vector is null, whose vector has another length or holds nulls or NaN, are not indexed; ties go to the smaller id; queries of another length find nothing.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.vectors import l2_pair

#: Rows that an index is fitted on, and held-out rows that calibrate it (on top of those).
FIT_ROWS, HELD_OUT = 20_000, 400
#: Cells of an IVF index at most (folders of its table).
MOST_CELLS = 4_096
KINDS = ("ivf_flat", "ivf_pq", "lsh")


# ------------------------------------------------------------------ fitting


def _good(df: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    v = F.col(vector)
    sound = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.select(F.col(id_col).alias("id"), v.cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & sound)


def _sample(rows: DataFrame, dim: int) -> np.ndarray:
    """Rows with the least hashes of their ids (a bounded number reaches the driver)."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS + HELD_OUT).select("v").toArrow()["v"]
    return _matrix(got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got, dim)


def _matrix(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.list_(pa.float32()))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(col), dim)


def _centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of k-means; begins with spread-out rows."""
    k = max(1, min(k, len(x)))
    c = x[np.linspace(0, max(len(x) - 1, 0), k).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        for j in range(k):
            if (mine := own == j).any():
                c[j] = x[mine].mean(0)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2.0 * (x @ c.T) + (c**2).sum(1)[None, :]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _distances(x, c).argmin(1)


def _codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest word of each part's book; ``books``: (parts, words, length of a part)."""
    step = books.shape[2]
    return np.stack([_nearest(x[:, m * step : (m + 1) * step], b) for m, b in enumerate(books)], axis=1).astype(np.int8)


def _bits(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The bucket of each row in each table; ``planes``: (tables, bits, dim)."""
    t, b, d = planes.shape
    on = (x @ planes.reshape(t * b, d).T > 0).reshape(len(x), t, b)
    return (on * (1 << np.arange(b))).sum(2).astype(np.int32)


def _needed(values: np.ndarray, recall: float) -> int:
    return int(np.quantile(values, recall, method="higher")) if len(values) else 0


def _fit(kind: str, x: np.ndarray, n: int, cells: int, parts: int, words: int, recall: float, k: int, seed: int) -> dict:
    """Everything but the rows: a small description (some MB at most) that is stored beside them."""
    held = min(HELD_OUT, len(x) // 5)
    fit, q = x[held:], x[:held]
    sims = _distances(q, x) if held else np.zeros((0, len(x)))
    sims[np.arange(held), np.arange(held)] = np.inf
    kk = min(k, max(0, len(x) - 1))
    near = np.argsort(sims, axis=1, kind="stable")[:, :kk]
    meta: dict = {"kind": kind, "n": n, "dim": x.shape[1]}
    if kind == "lsh":
        bits = int(min(14, max(2, np.ceil(np.log2(max(n, 2) / 64)))))
        planes = np.random.default_rng(seed).normal(size=(8, bits, x.shape[1])).astype(np.float32)
        code = _bits(x, planes)
        apart = np.bitwise_count(code[:held, None, :] ^ code[near]).min(axis=2) if held else np.zeros(0)
        return meta | {"planes": planes.tolist(), "radius": min(bits, _needed(apart.ravel(), recall))}
    centres = _centres(fit if len(fit) else np.zeros((1, x.shape[1]), np.float32), cells)
    order = np.argsort(_distances(q, centres), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    own = _nearest(x, centres) if len(x) else np.zeros(0, int)
    nprobe = 1 + _needed(np.take_along_axis(rank, own[near], axis=1).ravel() if held else np.zeros(0), recall if kind == "ivf_flat" else 1 - (1 - recall) / 2)
    meta |= {"centres": centres.tolist(), "nprobe": min(nprobe, len(centres))}
    if kind == "ivf_pq":
        step = x.shape[1] // parts
        books = np.stack([_centres(fit[:, m * step : (m + 1) * step], words) for m in range(parts)]) if len(fit) else np.zeros((parts, 1, step), np.float32)
        code = _codes(x, books)
        behind = []
        for i in range(held):
            table = ((q[i].reshape(parts, 1, step) - books) ** 2).sum(2)
            rough = table[np.arange(parts)[None, :], code].sum(1)
            rough[i] = np.inf
            seen = rank[i, own] < nprobe
            place = (rough[seen][None, :] < rough[near[i]][:, None]).sum(1)
            behind.append(place[seen[near[i]]])
        worst = _needed(np.concatenate(behind) if behind else np.zeros(0), 1 - (1 - recall) / 2) + 1
        meta |= {"books": books.tolist(), "rerank": int(np.ceil(worst * max(1.0, n / max(len(x), 1)) / max(k, 1))) + 1}
    return meta


# ------------------------------------------------------------------ building


def build(df: DataFrame, path: str, kind: str, id_col: str = "vec_id", vector: str = "embedding", dim: int = 64, cells: int | None = None, parts: int = 8, words: int = 32, recall: float = 0.98, k: int = 10, seed: int = 7) -> None:
    """Writes an index of ``df`` below ``path``; ``cells`` defaults to the square root of the number of rows."""
    if kind not in KINDS:
        raise ValueError(f"index kind {kind} is not supported")
    if dim % parts and kind == "ivf_pq":
        raise ValueError("the parts must divide the length of the vectors")
    spark = df.sparkSession
    rows = _good(df, id_col, vector, dim)
    n = rows.count()
    meta = _fit(kind, _sample(rows, dim), n, cells or max(4, min(MOST_CELLS, int(n**0.5))), parts, words, recall, k, seed)
    id_type = rows.schema["id"].dataType.simpleString()
    meta["id_type"] = id_type
    shared = spark.sparkContext.broadcast(meta)
    if kind == "lsh":

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.array(shared.value["planes"], np.float32)
            for b in batches:
                code = _bits(_matrix(b["v"], dim), planes)
                at = np.repeat(np.arange(len(code)), code.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(code.shape[1], dtype=np.int32), len(code))), pa.array(code.ravel()), b["id"].take(pa.array(at))], names=["tbl", "bucket", "id"])

        # ids in order of their buckets, so that readers skip row groups; hot buckets may span files
        keyed = rows.mapInArrow(hashed, f"tbl int, bucket int, id {id_type}").repartitionByRange("tbl", "bucket", "id").sortWithinPartitions("tbl", "bucket", "id")
        keyed.write.mode("overwrite").partitionBy("tbl").parquet(f"{path}/buckets")
        rows.write.mode("overwrite").parquet(f"{path}/rows")
    else:

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            centres = np.array(m["centres"], np.float32)
            books = np.array(m["books"], np.float32) if "books" in m else None
            for b in batches:
                x = _matrix(b["v"], dim)
                cols = [b["id"], b["v"], pa.array(_nearest(x, centres).astype(np.int32))]
                if books is not None:
                    code = _codes(x, books)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * code.shape[1]), pa.array(code.ravel())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "v", "cell", "codes"][: len(cols)])

        schema = f"id {id_type}, v array<float>, cell int" + (", codes array<tinyint>" if kind == "ivf_pq" else "")
        # by range of cell and id: a cell that holds a third of all rows spans many files
        rows.mapInArrow(placed, schema).repartitionByRange("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


# ------------------------------------------------------------------ searching


class Index:
    """An index that was built below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        self.dim = self.meta["dim"]

    @property
    def kind(self) -> str:
        return self.meta["kind"]

    def _table(self, name: str, columns: str) -> DataFrame:
        return self.spark.read.schema(f"id {self.meta['id_type']}, {columns}").parquet(f"{self.path}/{name}")

    def one(self, query: Sequence[float]) -> DataFrame:
        return self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, q array<double>")

    def search(self, queries: DataFrame | Sequence[float], k: int = 10, width: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` nearest rows of each query of a frame (query_id, q), or of one vector.

        ``width`` replaces the calibrated number of cells, or of bits in which a bucket may differ.
        """
        single = not isinstance(queries, DataFrame)
        asked = self.one(queries) if single else queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
        asked = asked.filter(F.size("q") == self.dim)
        found = self._buckets(asked, width) if self.kind == "lsh" else self._cells(asked, width, k)
        order = Window.partitionBy("query_id").orderBy("score", "id")
        scored = found.withColumn("score", l2_pair(F.col("v"), F.col("q"))).select("query_id", "id", "score")
        out = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return out.drop("query_id") if single else out

    def _cells(self, asked: DataFrame, width: int | None, k: int) -> DataFrame:
        meta, dim = self.meta, self.dim
        shared = self.spark.sparkContext.broadcast(meta)
        nprobe = width or meta["nprobe"]

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = np.array(shared.value["centres"], np.float32)
            for b in batches:
                cells = np.argsort(_distances(_matrix(b["q"], dim), centres), axis=1, kind="stable")[:, :nprobe]
                at = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b["query_id"].take(at), b["q"].take(at), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "q", "cell"])

        visits = asked.mapInArrow(visit, f"query_id {asked.schema['query_id'].dataType.simpleString()}, q array<double>, cell int")
        # Spark broadcasts the visits while they are few and then reads their cells' folders only
        columns = "v array<float>, cell int" + (", codes array<tinyint>" if "books" in meta else "")
        near = self._table("rows", columns).join(visits, "cell")
        if "books" not in meta:
            return near.select("query_id", "q", "id", "v")
        books = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in b]) for b in meta["books"]])
        step = dim // len(meta["books"])
        word = F.transform(F.col("codes"), lambda c, m: F.get(F.get(books, m), c.cast("int")))
        rough = F.aggregate(F.zip_with(F.flatten(word), F.slice("q", 1, step * len(meta["books"])), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        order = Window.partitionBy("query_id").orderBy("rough", "id")
        best = near.withColumn("rough", rough).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k * meta["rerank"])
        return best.select("query_id", "q", "id", "v")

    def _buckets(self, asked: DataFrame, width: int | None) -> DataFrame:
        dim = self.dim
        shared = self.spark.sparkContext.broadcast(self.meta)
        bits = len(self.meta["planes"][0])
        radius = self.meta["radius"] if width is None else width
        flips = np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], np.int32)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = np.array(shared.value["planes"], np.float32)
            for b in batches:
                code = _bits(_matrix(b["q"], dim), planes)  # (rows, tables)
                every = code[:, :, None] ^ flips[None, None, :]
                n, t, f = every.shape
                at = pa.array(np.repeat(np.arange(n), t * f))
                yield pa.RecordBatch.from_arrays([b["query_id"].take(at), pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), f), n)), pa.array(every.ravel())], names=["query_id", "tbl", "bucket"])

        visits = asked.mapInArrow(visit, f"query_id {asked.schema['query_id'].dataType.simpleString()}, tbl int, bucket int")
        hits = self._table("buckets", "tbl int, bucket int").join(visits, ["tbl", "bucket"]).select("query_id", "id").distinct()
        return hits.join(self._table("rows", "v array<float>"), "id").join(asked, "query_id").select("query_id", "q", "id", "v")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_exact, n_found, recall): how many of the exact hits (query_id, id) an index found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    out = hit.agg(F.count("*").alias("n_exact"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
    return out.withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))
