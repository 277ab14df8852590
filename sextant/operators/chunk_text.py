"""Chunks of plain text and Markdown, in Spark SQL only.

Input: ``path`` and ``content``. Null contents give no chunk; an empty text gives none either, but for
whole-file chunks, where it is one empty chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import basename, is_blank, split_lines, strip_ws

HEADER = r"(?s)^(#{1,6})\s+(.+)\z"


def _cut(lines: Column, first: Column, last: Column) -> Column:
    """The text of lines ``first`` to ``last``."""
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def _numbered(files: DataFrame) -> DataFrame:
    """(path, lines, at): the lines of each file and their numbers, from 1. Everything about a file is worked out in its own row, so nothing is shuffled."""
    lines = files.filter(F.col("content").isNotNull() & (F.col("content") != "")).select("path", split_lines(F.col("content")).alias("lines"))
    return lines.select("path", "lines", F.sequence(F.lit(1), F.size("lines")).alias("at"))


def chunk_blank_lines(files: DataFrame) -> DataFrame:
    """Maximal runs of lines that are not blank."""
    rows = _numbered(files).withColumn("full", F.transform("lines", lambda x: ~is_blank(x)))
    full = lambda i: F.coalesce(F.get("full", i - 1), F.lit(False))
    before = lambda i: F.when(i > 1, full(i - 1)).otherwise(False)
    firsts = F.filter("at", lambda i: full(i) & ~before(i))
    lasts = F.filter("at", lambda i: full(i) & ~full(i + 1))
    rows = rows.select("path", "lines", F.arrays_zip(firsts.alias("first"), lasts.alias("last")).alias("runs"))
    chunks = F.transform("runs", lambda r: F.struct(r["first"].alias("line_start"), r["last"].alias("line_end"), _cut(F.col("lines"), r["first"], r["last"]).alias("code")))
    return rows.select("path", F.explode(chunks).alias("c")).select(F.col("path").alias("file_path"), "c.*")


def chunk_whole(files: DataFrame, compat: bool = True) -> DataFrame:
    """One chunk per file. ``compat``: line_end is the length in bytes, else the number of lines."""
    end = F.octet_length("content") if compat else F.size(split_lines(F.col("content")))
    return files.filter(F.col("content").isNotNull()).select(
        F.col("path").alias("file_path"), *[c for c in ("language",) if c in files.columns], F.lit(1).alias("line_start"), end.cast("int").alias("line_end"),
        F.col("content").alias("code"), F.lit("document").alias("chunk_type"), basename(F.col("path")).alias("name"),
    )


_STACK = "struct<out:array<struct<ln:int,parents:array<string>>>,st:array<string>,txt:string,lvl:int>"


def parent_headings(headers: Column, compat: bool = True) -> Column:
    """Breadcrumbs of an ordered array of (ln, lvl, txt): an array of (ln, parents).

    ``compat`` keeps the usual shortcut of truncating to level - 2, by which a second sibling loses
    its direct parent; otherwise the true ancestors come out.
    """
    if compat:
        def step(acc, h):
            up = F.slice(acc["st"], 1, F.greatest(h["lvl"] - 2, F.lit(0)))
            down = F.when(acc["txt"] != "", F.concat(acc["st"], F.array(acc["txt"]))).otherwise(acc["st"])
            st = F.when(h["lvl"] == 1, F.array().cast("array<string>")).when(h["lvl"] > acc["lvl"], down).otherwise(up)
            return F.struct(
                F.concat(acc["out"], F.array(F.struct(h["ln"].alias("ln"), st.alias("parents")))).alias("out"),
                st.alias("st"), h["txt"].alias("txt"), h["lvl"].alias("lvl"),
            )

        zero = F.struct(
            F.array().cast("array<struct<ln:int,parents:array<string>>>").alias("out"), F.array().cast("array<string>").alias("st"),
            F.lit("").alias("txt"), F.lit(0).alias("lvl"),
        )
        return F.aggregate(headers, zero, step, lambda a: a["out"])
    kept = "array<struct<lvl:int,txt:string>>"

    def tree(acc, h):
        st = F.filter(acc["st"], lambda x: x["lvl"] < h["lvl"])
        names = F.transform(st, lambda x: x["txt"])
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(h["ln"].alias("ln"), names.alias("parents")))).alias("out"),
            F.concat(st, F.array(F.struct(h["lvl"].alias("lvl"), h["txt"].alias("txt")))).alias("st"),
        )

    zero = F.struct(F.array().cast("array<struct<ln:int,parents:array<string>>>").alias("out"), F.array().cast(kept).alias("st"))
    return F.aggregate(headers, zero, tree, lambda a: a["out"])


def chunk_markdown(files: DataFrame, compat: bool = True) -> DataFrame:
    """A section per header of any level, with its heading, level and parents.

    Text before the first header is a ``content`` chunk; a file without header is one ``document``
    named after the file.  Fences are not looked at.
    """
    level = lambda x: F.length(F.regexp_extract(x, HEADER, 1))  # noqa: E731 (0 for other lines)
    rows = _numbered(files).withColumn("levels", F.transform("lines", level))
    heads = F.filter("at", lambda i: F.get("levels", i - 1) > 0)
    described = F.transform("heads", lambda i: F.struct(i.alias("ln"), F.get("levels", i - 1).alias("lvl"), strip_ws(F.regexp_extract(F.get("lines", i - 1), HEADER, 2)).alias("txt")))
    rows = rows.withColumn("heads", heads).withColumn("heads", described)
    # what stands before the first header is a section without one
    none = F.struct(F.lit(1).alias("ln"), F.lit(0).alias("lvl"), F.lit("").alias("txt"))
    every = F.when((F.size("heads") > 0) & (F.get("heads", F.lit(0))["ln"] == 1), F.col("heads")).otherwise(F.concat(F.array(none), "heads"))
    parents = F.map_from_entries(F.transform(parent_headings(F.col("heads"), compat), lambda p: F.struct(p["ln"], F.array_join(p["parents"], " > "))))
    rows = rows.select("path", "lines", every.alias("every"), parents.alias("parents"))
    section = F.transform("every", lambda h, k: F.struct(
        h["ln"].alias("line_start"), (F.coalesce(F.get("every", k + 1)["ln"], F.size("lines") + 1) - 1).alias("line_end"), h["lvl"].alias("lvl"), h["txt"].alias("txt"),
        F.when(h["lvl"] > 0, F.try_element_at("parents", h["ln"])).alias("parent_heading"),
    ))
    rows = rows.select("path", "lines", section.alias("sections"))
    cut = F.transform("sections", lambda x: F.struct(x.alias("s"), _cut(F.col("lines"), x["line_start"], x["line_end"]).alias("code")))
    out = rows.select("path", F.size("sections").alias("n_sections"), F.explode(cut).alias("c")).select("path", "n_sections", "c.s.*", "c.code")
    titled = F.col("txt")
    single = (F.col("n_sections") == 1) & (titled == "")
    return out.select(
        F.col("path").alias("file_path"), "line_start", "line_end", "code",
        F.when(single, "document").when(titled == "", "content").otherwise("section").alias("chunk_type"),
        F.when(single, basename(F.col("path"))).otherwise(titled).alias("heading"),
        F.when(titled == "", "").otherwise(F.col("lvl").cast("string")).alias("heading_level"),
        F.coalesce("parent_heading", F.lit("")).alias("parent_heading"),
        titled.alias("name"),
    )
