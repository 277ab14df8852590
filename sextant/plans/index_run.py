"""One indexing run: list, compare with the stored state, chunk what changed, embed, commit."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.lang import STRICT
from sextant.operators import chunk_code, chunk_text, incremental
from sextant.operators.embed import DIM, Embedder, embed_two_passes
from sextant.schema import RAW_CHUNKS
from sextant.sources.listing import list_files, read_contents
from sextant.sources.store import Store

TEXT = ("text", "rst")
#: Files that one task reads and chunks.
FILES_PER_TASK = 500


@dataclass
class Report:
    new: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    up_to_date: bool = False
    languages: dict[str, int] = field(default_factory=dict)  # files to index, per language


def chunk_files(files: DataFrame, compat: bool = True) -> DataFrame:
    """Chunks of (path, language, content), each file by the chunker of its language, in the shape of the table without vectors.

    A file of a language without a chunker fails the run; files without language are left out.
    """
    known = F.col("language").isin("markdown", *TEXT, *chunk_code.LANGUAGES)
    unknown = F.raise_error(F.concat(F.lit("no chunker for language "), "language")).cast("string")
    files = files.filter("language IS NOT NULL").withColumn("language", F.when(known, F.col("language")).otherwise(unknown))
    code = files.filter(~F.col("language").isin("markdown", *TEXT))
    empty = F.lit("")
    made = chunk_code.chunk_code(code).withColumns({
        "embedding_type": F.lit("code"), "heading": empty, "heading_level": empty, "parent_heading": empty,
        "metadata": F.map_filter(F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("signature"), "signature", F.lit("receiver"), "receiver", F.lit("doc_comment"), "doc_comment")), lambda k, v: v != ""),
    })
    none = F.create_map().cast("map<string,string>")
    md = chunk_text.chunk_markdown(files.filter("language = 'markdown'"), compat).withColumns({"language": F.lit("markdown"), "embedding_type": F.lit("docs"), "metadata": none})
    plain = files.filter(F.col("language").isin(*TEXT))
    whole = chunk_text.chunk_whole(plain, compat).withColumns({"embedding_type": F.lit("docs"), "heading": empty, "heading_level": empty, "parent_heading": empty, "metadata": F.create_map(F.lit("filename"), F.col("name"))})
    names = [f.name for f in RAW_CHUNKS.fields if f.name != "chunk_id"]
    rows = made.select(*names).unionByName(md.select(*names)).unionByName(whole.select(*names))
    return chunk_code.with_ids(rows).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_CHUNKS.fields])


def index(spark: SparkSession, root: str, store: Store, code: Embedder, docs: Embedder, table: dict[str, str] = STRICT, dim: int = DIM, workers: int = 32, batch: int = 8) -> Report:
    """Brings the store up to date with the tree; one commit, so a failed run leaves the old state."""
    began = datetime.now(timezone.utc)
    scan = list_files(spark, root, table).persist()
    try:
        with store.writing():  # the state that the run compares with is the one it changes
            actions = incremental.plan(scan, store.files()).persist()
            counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
            report = Report(**{k: counts.get(k, 0) for k in ("new", "modified", "deleted", "unchanged")})
            if not (report.new or report.modified or report.deleted):
                report.up_to_date = True
                return report
            todo = scan.join(actions.filter(F.col("action").isin("new", "modified")).select("path"), "path", "left_semi")
            report.languages = {r["language"]: r["n"] for r in todo.groupBy("language").agg(F.count("*").alias("n")).collect()}  # one row per language
            parts = max(workers, -(-(report.new + report.modified) // FILES_PER_TASK))
            fresh = embed_two_passes(chunk_files(read_contents(todo.select("path", "language"), parts)), code, docs, dim=dim, workers=workers, batch=batch)
            stale = actions.filter(F.col("action").isin("modified", "deleted")).select("path")
            store.upsert(stale, fresh if report.new or report.modified else None, scan, began)
        return report
    finally:
        scan.unpersist()


def stats(store: Store) -> DataFrame:
    """One row: chunks, files, code and docs chunks."""
    return store.chunks().agg(
        F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.count_if(F.col("embedding_type") == "code").alias("n_code"),
        F.count_if(F.col("embedding_type") == "docs").alias("n_docs"),
    )
