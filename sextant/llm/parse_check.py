"""Source files that cannot be read as the language of their extension (problem 4).

Each file's whole token stream goes through a table-driven recogniser that is built from a bundled
grammar.  Tables are made once on the driver (fixed size, independent of the data) and broadcast; files are
independent of each other, so the work needs no shuffle.

Defined results: null contents are left out (nothing can be read); an empty file is valid except in Go, which
needs a package clause; repeated rows are judged each for itself; null paths and other extensions are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import extension
from sextant.llm import lr_tables
from sextant.llm.syntax import LANGUAGES, Reader
from sextant.session import spread

_READERS: dict[str, Reader] = {}


def all_tables(spark):
    """The tables of every language, as a broadcast (kept with the session's context)."""
    held = getattr(spark.sparkContext, "_sextant_tables", None)
    if held is None:
        held = spark.sparkContext.broadcast({name: lr_tables.load(name) for name in sorted(set(LANGUAGES.values()))})
        spark.sparkContext._sextant_tables = held
    return held


def reader(language: str, tables) -> Reader:
    """This process's reader; what it has learnt serves later tasks too."""
    if language not in _READERS:
        _READERS[language] = Reader(language, tables.value[language])
    return _READERS[language]


def judged_files(files: DataFrame) -> DataFrame:
    """(path, lang, content) of the files to judge."""
    lang = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        lang = F.when(extension(F.col("path")) == e, name).otherwise(lang)
    return spread(files.select("path", lang.alias("lang"), "content").filter("lang is not null and content is not null"))


def syntax_report(files: DataFrame) -> DataFrame:
    """(path, lang, valid, fault_line, fault): one row per judged file of ``files`` (path, content)."""
    tables = all_tables(files.sparkSession)
    schema = pa.schema([("path", pa.string()), ("lang", pa.string()), ("valid", pa.bool_()), ("fault_line", pa.int32()), ("fault", pa.string())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [reader(lang, tables).check(text) for lang, text in zip(b["lang"].to_pylist(), b["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b["path"], b["lang"], pa.array([f is None for f in found]),
                pa.array([f.line if f else None for f in found], pa.int32()), pa.array([f.what if f else None for f in found], pa.string()),
            ], schema=schema)

    return judged_files(files).mapInArrow(judge, "path string, lang string, valid boolean, fault_line int, fault string")


def fault_rates(report: DataFrame, listing: DataFrame) -> DataFrame:
    """(repo, lang, n_files, n_invalid, invalid_share). A path's repo is that of its newest listing; without one, null."""
    newest = F.max_by("repo", F.struct(F.coalesce(F.col("listed_at"), F.lit("1970-01-01").cast("timestamp")), F.coalesce("repo", F.lit("")))).alias("repo")
    repos = listing.filter("path is not null").groupBy("path").agg(newest)
    per = report.join(repos, "path", "left").groupBy("repo", "lang")
    out = per.agg(F.count("*").alias("n_files"), F.sum((~F.col("valid")).cast("int")).alias("n_invalid"))
    return out.withColumn("invalid_share", F.round(F.col("n_invalid") / F.col("n_files"), 6))
