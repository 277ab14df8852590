"""Full-text index and BM25 ranking as joins and groupings; LIKE remains the plain way.

The index is two Parquet tables below a folder: postings partitioned by a hash of the term and sorted by it, and the totals.
A search reads only the folders of its terms.

Defined results: null ids and null texts are not indexed; terms are runs of ASCII letters, digits and underscores in lower case; asked terms are compared in lower case and count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders into which terms are hashed.
BUCKETS = 64


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf, size): the inverted index. Terms are counted before anything is shuffled by term."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), _words(text).alias("words"))
    return rows.select("id", F.size("words").alias("size"), F.explode("words").alias("term")).groupBy("id", "size", "term").agg(F.count("*").alias("tf"))


def build(df: DataFrame, path: str, id_col: str, text: str) -> None:
    """Writes the index below ``path``. A term that many texts hold is spread over several files by the range of its ids."""
    rows = postings(df, id_col, text).withColumn("bucket", _bucket(F.col("term"))).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    sized = df.filter(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.size(_words(text)).alias("size"))
    sized.agg(F.count("*").alias("n_texts"), F.avg("size").alias("mean"), F.lit(df.schema[id_col].dataType.simpleString()).alias("id_type")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def search(spark: SparkSession, path: str, terms: Sequence[str], k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the ``k`` best texts for the terms, from a stored index."""
    asked = sorted({t.lower() for t in terms})
    totals = spark.read.parquet(f"{path}/totals")  # one row
    stored = spark.read.schema(f"id {totals.first()['id_type']}, size int, term string, tf long, bucket int").parquet(f"{path}/postings")
    wanted = F.lit(False)
    for t in asked:
        wanted = wanted | ((F.col("bucket") == _bucket(F.lit(t))) & (F.col("term") == t))
    hits = stored.filter(wanted).select("id", "term", "tf", "size")
    numbers = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row per asked term
    rows = hits.join(F.broadcast(numbers), "term").join(F.broadcast(totals), F.lit(True))
    idf = F.log(F.lit(1.0) + (F.col("n_texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("size") / F.col("mean")))
    return rows.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(k)
