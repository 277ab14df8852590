"""Search in code, docs or both: embed, filtered kNN, union, dedup by text, sort, limit."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.knn import DEFAULT_LIMIT, knn
from sextant.schema import RESULT_COLUMNS

MODES = ("code", "docs", "hybrid")


def resolve_mode(code: bool = False, docs: bool = False, hybrid: bool = False) -> str:
    """One mode of three; none given means hybrid, more than one is an error."""
    given = [m for m, on in zip(MODES, (code, docs, hybrid), strict=True) if on]
    if len(given) > 1:
        raise ValueError("only one of code, docs and hybrid can be given")
    return given[0] if given else "hybrid"


def dedup_by_text(hits: DataFrame) -> DataFrame:
    """One row per text: the lowest (score, side, chunk_id). Null texts count as one text."""
    row = F.struct(*[c for c in hits.columns])
    best = F.min_by(row, F.struct("score", "side", "chunk_id"))
    return hits.groupBy("code").agg(best.alias("best")).select("best.*")


def hits(chunks: DataFrame, vectors: dict[str, Sequence[float]], mode: str = "hybrid", limit: int = DEFAULT_LIMIT, **knn_args) -> DataFrame:
    """Nearest rows of each side that the mode asks for, before dedup. ``vectors``: query by side."""
    sides = ("code", "docs") if mode == "hybrid" else (mode,)
    parts = [
        knn(chunks, vectors[s], limit, F.col("embedding_type") == s, **knn_args).withColumn("side", F.lit(("code", "docs").index(s)))
        for s in sides
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(chunks: DataFrame, vectors: dict[str, Sequence[float]], mode: str = "hybrid", limit: int = DEFAULT_LIMIT, **knn_args) -> DataFrame:
    """Search results, best first.

    The kNN limit applies before texts are deduplicated, so fewer rows than ``limit`` can come
    back.  ``limit`` <= 0 asks each side for ten and leaves out the last cut.
    """
    found = dedup_by_text(hits(chunks, vectors, mode, limit, **knn_args)).drop("side").orderBy("score", "chunk_id")
    return found.limit(limit) if limit > 0 else found


def with_defaults(results: DataFrame) -> DataFrame:
    """The public result columns in order, with typed defaults where a column is missing or null."""
    defaults = {"line_start": F.lit(0), "line_end": F.lit(0), "score": F.lit(0.0)}
    cols = []
    for c in RESULT_COLUMNS:
        d = defaults.get(c, F.lit(""))
        cols.append((F.coalesce(F.col(c), d) if c in results.columns else d).alias(c))
    return results.select(*cols)


def envelope(query: str, mode: str, before: DataFrame, returned: DataFrame) -> DataFrame:
    """One row: query, mode, number of hits before dedup, number returned, results in order.

    Both inputs are bounded by the search limit.
    """
    total = before.agg(F.count("*").alias("total_results")).withColumn("k", F.lit(1))
    row = F.struct("score", "chunk_id", F.struct(*[F.when(F.col(c) != "", F.col(c)).alias(c) if c in RESULT_COLUMNS[8:] else F.col(c) for c in RESULT_COLUMNS]).alias("r"))
    got = with_defaults(returned).agg(F.count("*").alias("returned"), F.array_sort(F.collect_list(row)).alias("rs"))
    got = got.select("returned", F.transform("rs", lambda x: x["r"]).alias("results"), F.lit(1).alias("k"))
    return total.join(got, "k").select(F.lit(query).alias("query"), F.lit(mode).alias("mode"), "total_results", "returned", "results")


def to_json(env: DataFrame) -> DataFrame:
    return env.select(F.to_json(F.struct(*env.columns), {"pretty": "true"}).alias("json"))


def to_text(results: DataFrame) -> DataFrame:
    """Human-readable lines in rank order: rank, place, score, headings and the first 100 characters."""
    head = F.format_string("%s:%d-%d  score %.4f", "file_path", "line_start", "line_end", "score")
    titled = F.when(F.col("heading") != "", F.concat(F.lit("  # "), "heading")).otherwise("")
    under = F.when(F.col("parent_heading") != "", F.concat(F.lit("  under "), "parent_heading")).otherwise("")
    text = F.concat(head, titled, under, F.lit("\n    "), F.substring("code", 1, 100))
    return with_defaults(results).orderBy("score", "chunk_id").select(text.alias("line"))


def glob_pattern(glob: str) -> str:
    """A shell pattern over whole paths as a regular expression: ``*`` and ``?`` also cross folders, ``[...]`` is a set."""
    return "(?s)\\A" + re.sub(r"\\z$|\\Z$", "", fnmatch.translate(glob).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")) + "\\z"


def post_filters(results: DataFrame, language: str | None = None, path_contains: str | None = None, score_band: tuple[float, float] | None = None, path_glob: str | None = None) -> DataFrame:
    """Optional filters on finished results."""
    if path_glob is not None:
        results = results.filter(F.col("file_path").rlike(glob_pattern(path_glob)))
    if language is not None:
        results = results.filter(F.col("language") == language)
    if path_contains is not None:
        results = results.filter(F.col("file_path").contains(path_contains))
    if score_band is not None:
        results = results.filter(F.col("score").between(*score_band))
    return results


def search_text(chunks: DataFrame, text: str, embed: dict[str, Callable[[str], Sequence[float]]], mode: str = "hybrid", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """As :func:`search`, the query given as text and embedded once per side."""
    sides = ("code", "docs") if mode == "hybrid" else (mode,)
    return search(chunks, {s: embed[s](text) for s in sides}, mode, limit)
