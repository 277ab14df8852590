"""Sizes of texts in tokens of a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import spread

#: Default vocabulary (ranks of a byte-level BPE).
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts texts before byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """This process's tokenizer."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, path: str = DEFAULT, text: str = "text") -> DataFrame:
    """``docs`` without its text and with ``n_tokens``; null and empty texts have 0."""
    kept = [c for c in docs.columns if c not in (text, "n_tokens")]
    schema = docs.select(*kept, F.lit(0).alias("n_tokens")).schema
    for f in schema.fields:
        f.nullable = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(sizes, pa.int32())], names=[*kept, "n_tokens"])

    return spread(docs.select(*kept, text)).mapInArrow(count, schema)
