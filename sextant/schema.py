"""Explicit schemas of the stored tables and of search results."""

from pyspark.sql import types as T

SCHEMA_VERSION = 1

_TEXT = ("heading", "heading_level", "parent_heading")


def _s(name: str, nullable: bool = False) -> T.StructField:
    return T.StructField(name, T.StringType(), nullable)


#: One row per chunk. ``name`` and ``metadata`` are kept beside the twelve public columns.
CHUNKS = T.StructType(
    [
        _s("chunk_id"),
        _s("file_path"),
        T.StructField("line_start", T.IntegerType(), False),
        T.StructField("line_end", T.IntegerType(), False),
        _s("language"),
        _s("code"),
        _s("chunk_type", True),
        *[_s(c, True) for c in _TEXT],
        _s("embedding_type"),
        _s("name", True),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("vector", T.ArrayType(T.FloatType(), True), False),
    ]
)

#: Chunk columns before embedding.
RAW_CHUNKS = T.StructType([f for f in CHUNKS.fields if f.name not in ("vector",)])

#: The file state that incremental runs compare with.
FILES = T.StructType([_s("path"), _s("language", True), T.StructField("mod_time", T.TimestampType(), True)])

#: Columns of a search result, in output order.
RESULT_COLUMNS = (
    "chunk_id", "file_path", "line_start", "line_end", "language", "code", "score",
    "embedding_type", "chunk_type", "heading", "heading_level", "parent_heading",
)
