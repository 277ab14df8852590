"""Text expressions built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_ws(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` strips blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(line: Column) -> Column:
    """True for a line of white space only."""
    return F.regexp_replace(line, r"\s+", "") == ""


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot, or an empty text."""
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)$", 1)


def split_lines(text: Column) -> Column:
    """Lines of a text without their line ends; a last empty line does not count."""
    cut = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(cut, r"\r?\n"))


def code_points(text: Column) -> Column:
    """Sum of the code points of a text."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c).cast("long")
    )


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over code points, as a long. Null stays null."""
    # Fixed values of the public FNV-1a hash: offset basis and prime.
    basis, prime = 2166136261, 16777619
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(prime).cast("long")).bitwiseAND(mask)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(basis).cast("long"), step)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
