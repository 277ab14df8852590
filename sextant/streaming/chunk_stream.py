"""A stream of source files kept in step with a store: each micro-batch is one upsert by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.operators.embed import DIM, Embedder, embed_two_passes
from sextant.plans.index_run import chunk_files
from sextant.sources.store import Store

FILES_SCHEMA = "path string, language string, content string, mod_time timestamp"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of (path, language, content, mod_time) that arrive in a folder."""
    return spark.readStream.schema(FILES_SCHEMA).parquet(folder)


def upsert_stream(files: DataFrame, store: Store, code: Embedder, docs: Embedder, checkpoint: str, dim: int = DIM) -> StreamingQuery:
    """Starts the stream. Of several versions of a path in one batch the newest counts; a null content deletes the path.

    A batch that is delivered again writes the same rows again, so the store does not change.
    """

    def batch(rows: DataFrame, _: int) -> None:
        newest = rows.filter("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("language", "content", "mod_time"), F.coalesce("mod_time", F.lit("1970-01-01").cast("timestamp"))).alias("r"))
        newest = newest.select("path", "r.*").persist()
        try:
            fresh = embed_two_passes(chunk_files(newest.select("path", "language", "content")), code, docs, dim=dim)
            with store.writing():
                state = store.files().join(newest.select("path"), "path", "left_anti").unionByName(newest.filter("content IS NOT NULL").select("path", "language", "mod_time"))
                store.upsert(newest.select("path"), fresh, state)
        finally:
            newest.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
