"""Items over a size limit cut into pieces at natural boundaries (problem 6).

An item's text is cut into atoms, its lines (and parts of lines that are too long alone).  Each boundary between atoms
has a strength: a blank line is stronger than a change of indentation, that is stronger than the next line.  Adjacent
pairs wait in a heap and are merged, the weakest boundary first, while the merged piece and the overlap fit.

Items are independent, so oversized ones are cut where they lie; only they reach Python.

Defined results: sizes are code points. Null texts and texts of up to ``capacity`` are not cut. Repeated rows (same id and text) count
once. Pieces cover the whole text: without their overlaps they concatenate to it. ``overlap`` must be less than half of ``capacity``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r"\s*(?:func|def|class|async def|function|export|public|private|protected|static|type|struct|interface|#{1,6} |@|/\*\*|//|#|\"\"\")")
_SENTENCE = re.compile(r"(?<=[.!?;:,}>])\s+|(?<=[;{},])(?=\S)|\s+")


def atoms(text: str, longest: int) -> list[tuple[int, int, float]]:
    """(start, end, strength of the boundary before it) of the atoms of a text, none longer than ``longest``."""
    out: list[tuple[int, int, float]] = []
    at, blank, indent_before = 0, True, 0
    for line in text.splitlines(keepends=True):
        body = line.strip()
        indent = len(line) - len(line.lstrip()) if body else indent_before
        strength = 1.0
        if blank and body:
            strength = 6.0 - min(indent, 16) / 8
        elif not body:
            strength = 0.5  # a blank line stays with what is above it
        elif _HEAD.match(line):
            strength = 4.0 - min(indent, 16) / 8
        elif indent < indent_before:
            strength = 1.5
        elif indent > indent_before:
            strength = 0.75
        if len(line) <= longest:
            out.append((at, at + len(line), strength))
        else:
            for k, (s, e, w) in enumerate(_parts(line, longest)):
                out.append((at + s, at + e, strength if k == 0 else w))
        at += len(line)
        blank, indent_before = not body, indent
    return out


def _parts(line: str, longest: int) -> Iterator[tuple[int, int, float]]:
    """Parts of a line that is too long: cut behind sentences, else behind words, else anywhere."""
    at, strength = 0, 0.0
    while len(line) - at > longest:
        cut, kind = at + longest, 0.05
        for m in _SENTENCE.finditer(line, at + longest // 2, at + longest):
            if m.end() > at:
                cut, kind = m.end(), 0.3 if line[m.start() - 1] in ".!?;:,}>{" else 0.2
        yield at, cut, strength
        at, strength = cut, kind
    yield at, len(line), strength


def merge(segments: list[tuple[int, int, float]], capacity: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces, without overlap, after agglomerative merging."""
    n = len(segments)
    start = [s for s, _, _ in segments]
    end = [e for _, e, _ in segments]
    right = list(range(1, n)) + [-1]
    left = [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(segments[i + 1][2], segments[i + 1][1] - segments[i][0], i, i + 1, end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, j, seen_end = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or end[j] != seen_end:
            continue
        if end[j] - start[i] + (overlap if start[i] > 0 else 0) > capacity:
            continue
        end[i], alive[j], right[i] = end[j], False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
            r = right[j]
            heapq.heappush(heap, (segments[r][2], end[r] - start[i], i, r, end[r]))
        if left[i] >= 0:
            p = left[i]
            heapq.heappush(heap, (segments[i][2], end[i] - start[p], p, i, end[i]))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def cut(text: str, capacity: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) of the pieces of a text: each begins ``overlap`` characters before its own part."""
    if len(text) <= capacity:
        return [(0, 0, len(text))]
    spans = merge(atoms(text, capacity - overlap), capacity, overlap)
    return [(max(0, s - overlap) if k else 0, s, e) for k, (s, e) in enumerate(spans)]


def split_oversized(df: DataFrame, capacity: int, overlap: int, id_col: str = "chunk_id", text: str = "code", path: str = "file_path", line: str = "line_start") -> DataFrame:
    """(id, path, piece_no, char_start, own_start, char_end, line_start, line_end, piece) for each distinct item over ``capacity``."""
    if not 0 <= overlap < capacity / 2:
        raise ValueError("overlap must be less than half of the capacity")
    kinds = {"id": "string", "path": "string", "piece_no": "int", "char_start": "int", "own_start": "int", "char_end": "int", "line_start": "int", "line_end": "int", "piece": "string"}
    arrow = {"string": pa.string(), "int": pa.int32()}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {k: [] for k in kinds}
            for ident, where, first, body in zip(*(b[c].to_pylist() for c in ("id", "path", "first", "body")), strict=True):
                breaks = [m.end() for m in re.finditer("\n", body)]
                at = 0
                for no, (s, own, e) in enumerate(cut(body, capacity, overlap)):
                    while at < len(breaks) and breaks[at] <= s:
                        at += 1
                    low = at
                    high = low
                    while high < len(breaks) and breaks[high] < e:
                        high += 1
                    base = 1 if first is None else first
                    for k, v in zip(kinds, (ident, where, no, s, own, e, base + low, base + high, body[s:e]), strict=True):
                        cols[k].append(v)
                    while at > 0 and breaks[at - 1] > own:
                        at -= 1
            yield pa.RecordBatch.from_arrays([pa.array(cols[k], arrow[t]) for k, t in kinds.items()], names=list(kinds))

    big = df.filter((F.length(text) > capacity) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(path).alias("path"), F.col(line).cast("int").alias("first"), F.col(text).alias("body")
    )
    # bodies are told apart by two hashes, so that no sort compares them
    one = big.groupBy("id", F.xxhash64("body").alias("h"), F.hash("body").alias("g")).agg(F.min("path").alias("path"), F.min("first").alias("first"), F.any_value("body").alias("body"))
    return one.select("id", "path", "first", "body").mapInArrow(pieces, ", ".join(f"{k} {t}" for k, t in kinds.items()))
