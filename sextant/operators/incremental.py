"""What an indexing run has to do: joins of the scanned files with the stored state.

Times are compared in microseconds on both sides. A null path never matches; a null time of a known
path counts as unchanged, of a stored row as older than any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_listing(listing: DataFrame) -> DataFrame:
    """One row per path of a scanner's list: the one with the newest time (ties: newest listing)."""
    row = F.struct(*[c for c in listing.columns])
    rank = F.struct(F.coalesce("mod_time", F.lit("1970-01-01").cast("timestamp")), F.coalesce("listed_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("language", F.lit("")))
    return listing.filter(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(row, rank).alias("r")).select("r.*")


def plan(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, action): ``new``, ``modified``, ``unchanged`` or ``deleted`` for each path of either side."""
    a = scan.filter("path is not null").groupBy("path").agg(F.max("mod_time").alias("now"))
    b = stored.filter("path is not null").groupBy("path").agg(F.max("mod_time").alias("was"), F.lit(True).alias("known"))
    a = a.withColumn("seen", F.lit(True))
    action = (
        F.when(F.col("seen").isNull(), "deleted")
        .when(F.col("known").isNull(), "new")
        .when((F.col("was").isNull() & F.col("now").isNotNull()) | (F.col("now") > F.col("was")), "modified")
        .otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").select("path", action.alias("action"))


def upsert(chunks: DataFrame, fresh: DataFrame, actions: DataFrame) -> DataFrame:
    """Chunks after a run: rows of modified and deleted paths go, the fresh rows come."""
    stale = actions.filter(F.col("action").isin("modified", "deleted")).select(F.col("path").alias("file_path"))
    return chunks.join(stale, "file_path", "left_anti").select(*chunks.columns).unionByName(fresh.select(*chunks.columns))


def nothing_to_do(actions: DataFrame) -> bool:
    return actions.filter(F.col("action") != "unchanged").isEmpty()
