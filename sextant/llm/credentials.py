"""Credentials written out in code, documentation and settings, and their redaction (problem 1).

A trigram index is built over each block of chunks (an Arrow batch): postings of the trigrams that the detection
regexes require, as bitmaps over the block.  Each regex's formula intersects them, and only chunks that come through
are read by that regex.  Blocks are independent, so nothing is shuffled and no task sees more than a block at a time.

Defined results: null code or a null chunk_id gives nothing found (and stays null when redacted); a null file_path counts as a
text file; repeated chunks give the same spans, once per distinct chunk_id in :func:`found`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.secret_rules import RULES, find
from sextant.llm.trigrams import Index, required
from sextant.session import spread

_INDEX: list[Index] = []

SPANS = "array<struct<char_start:int,char_end:int,rule:string>>"


def _index() -> Index:
    if not _INDEX:
        _INDEX.append(Index([required(r.regex) for r in RULES]))
    return _INDEX[0]


def _layout(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def spans_of(code: pa.Array, paths: pa.Array) -> list[list[tuple[int, int, str]]]:
    """The credentials of each chunk of a block."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(code))]
    wanted = _index().candidates(*_layout(code))
    for i in np.flatnonzero(wanted.any(axis=0)):
        out[i] = find(code[int(i)].as_py(), paths[int(i)].as_py() or "", tuple(np.flatnonzero(wanted[:, i])))
    return out


def find_spans(chunks: DataFrame) -> DataFrame:
    """(chunk_id, char_start, char_end, rule): the spans in every row of ``chunks`` (chunk_id, file_path, code)."""
    schema = pa.schema([("chunk_id", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("rule", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s, e, r) for i, spans in enumerate(spans_of(b["code"], b["file_path"])) for s, e, r in spans]
            at, start, end, rule = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["chunk_id"].take(pa.array(at, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(rule, pa.string())], schema=schema
            )

    wanted = chunks.filter("code is not null and chunk_id is not null").select("chunk_id", "file_path", "code")
    return spread(wanted).mapInArrow(scan, "chunk_id string, char_start int, char_end int, rule string")


def found(chunks: DataFrame) -> DataFrame:
    """One row per credential and distinct chunk_id."""
    return find_spans(chunks).select("chunk_id", "char_start", "char_end").distinct()


def redact(chunks: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """``chunks`` with the columns code_redacted and n_credentials: each value replaced, every other character as it was."""
    names = chunks.columns
    if clash := {"code_redacted", "n_credentials"} & set(names):
        chunks = chunks.drop(*clash)
        names = chunks.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            redacted, counts = [], []
            for text, spans in zip(b["code"].to_pylist(), spans_of(b["code"], b["file_path"]), strict=True):
                if spans:
                    parts, at = [], 0
                    for s, e, _ in spans:
                        parts += [text[at:s], mask]
                        at = e
                    text = "".join([*parts, text[at:]])
                redacted.append(text)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(redacted, pa.string()), pa.array(counts, pa.int32())], names=[*names, "code_redacted", "n_credentials"])

    schema = chunks.select("*", F.lit("").alias("code_redacted"), F.lit(0).alias("n_credentials")).schema
    for f in schema.fields:
        f.nullable = True
    return chunks.mapInArrow(scan, schema)
