"""A trigram index over a batch of texts, and the trigrams that a regex requires.

Required trigrams come from the regex's own syntax tree: literal runs give trigrams that must be there, alternatives give
a choice, repetitions that may be empty give nothing.  Texts are indexed by bytes in ASCII lower case, and so are the
trigrams, which makes the index blind to case.
"""

from __future__ import annotations

import re
from re import _constants as sc
from re import _parser as sp

import numpy as np

#: A formula: True, a trigram (three bytes), or ("and" | "or", parts).
Formula = object
#: Most strings that a run of literals may stand for before it is cut into trigrams.
STRINGS = 256


def _and(parts: list) -> Formula:
    flat = []
    for p in parts:
        if p is True:
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    return True if not flat else flat[0] if len(flat) == 1 else ("and", list(dict.fromkeys(map(_freeze, flat))))


def _or(parts: list) -> Formula:
    if any(p is True for p in parts):
        return True
    flat = list(dict.fromkeys(map(_freeze, parts)))
    return flat[0] if len(flat) == 1 else ("or", flat)


def _freeze(f):
    return (f[0], tuple(f[1])) if isinstance(f, tuple) else f


def _of_string(s: bytes) -> Formula:
    return _and([s[i : i + 3] for i in range(len(s) - 2)])


def _of_strings(strings: set[bytes]) -> Formula:
    return _or([_of_string(s) for s in strings]) if strings else True


def _low(char: int) -> bytes:
    return chr(char).encode("utf-8", "surrogatepass").lower()


def _set_members(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if op is sc.LITERAL:
            out.add(_low(arg))
        elif op is sc.RANGE and arg[1] - arg[0] <= 30:
            out |= {_low(c) for c in range(arg[0], arg[1] + 1)}
        elif op is sc.CATEGORY and arg is sc.CATEGORY_SPACE:
            out |= {b" ", b"\t", b"\n", b"\r", b"\f", b"\v"}
        else:
            return None
    return out if len(out) <= 40 else None


def _walk(seq) -> tuple[set[bytes] | None, Formula]:
    """(all strings that the sequence can be, or None; formula)."""
    run: set[bytes] = {b""}
    formula: list = []
    exact = True

    def flush() -> None:
        nonlocal run, exact
        formula.append(_of_strings(run))
        run, exact = {b""}, False

    for op, arg in seq:
        strings: set[bytes] | None = None
        inner: Formula = True
        if op is sc.LITERAL:
            strings = {_low(arg)}
        elif op is sc.IN:
            strings = _set_members(arg)
        elif op is sc.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is sc.BRANCH:
            got = [_walk(b) for b in arg[1]]
            strings = set().union(*[g[0] for g in got]) if all(g[0] is not None for g in got) else None
            inner = _or([g[1] for g in got])
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            low, high, body = arg
            s, f = _walk(body)
            if low == 0:
                strings = s | {b""} if high == 1 and s is not None else None
            elif low == high == 1:
                strings, inner = s, f
            else:
                inner = f if s is None else _of_strings(s)
        elif op is sc.AT or op is sc.ASSERT_NOT:
            continue
        elif op is sc.ASSERT:
            if arg[0] > 0:  # what must follow is part of the text too
                s, f = _walk(arg[1])
                if s is not None and len(run) * len(s) <= STRINGS:
                    formula.append(_of_strings({a + b for a in run for b in s}))
                formula.append(f)
            continue
        if inner is not True:
            formula.append(inner)
        if strings is None:
            flush()
        elif len(run) * len(strings) > STRINGS:
            flush()
            run = strings
        else:
            run = {a + b for a in run for b in strings}
    if exact:
        return run, _and([_of_strings(run), *formula])
    flush()
    return None, _and(formula)


def required(regex: re.Pattern) -> Formula:
    """The trigrams that every match of ``regex`` contains, as a formula."""
    return _walk(sp.parse(regex.pattern, regex.flags & ~re.UNICODE))[1]


def trigrams_of(formula: Formula) -> set[bytes]:
    if formula is True:
        return set()
    if isinstance(formula, bytes):
        return {formula}
    return set().union(*[trigrams_of(p) for p in formula[1]])


class Index:
    """Postings of a fixed vocabulary of trigrams over batches of texts."""

    def __init__(self, formulas: list[Formula]):
        self.formulas = formulas
        self.vocabulary = sorted(set().union(*[trigrams_of(f) for f in formulas]))
        self.row = {t: i for i, t in enumerate(self.vocabulary)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.row.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean matrix (trigram, text) of texts laid out in ``data`` from offset to offset."""
        n = len(offsets) - 1
        out = np.zeros((len(self.vocabulary), n), np.bool_)
        base = int(offsets[0])
        low = self.lower[data[base : int(offsets[-1])]]
        if len(low) < 3:
            return out
        step = 1 << 22
        for s in range(0, len(low) - 2, step):
            part = low[s : s + step + 2].astype(np.int32)
            ids = self.table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(ids >= 0)
            pos = at + s + base
            text = np.searchsorted(offsets, pos, "right") - 1
            inside = pos + 2 < offsets[text + 1]
            out[ids[at[inside]], text[inside]] = True
        return out

    def select(self, postings: np.ndarray, formula: Formula) -> np.ndarray:
        """Texts that a formula lets through: intersections and unions of postings."""
        if formula is True:
            return np.ones(postings.shape[1], np.bool_)
        if isinstance(formula, bytes):
            return postings[self.row[formula]]
        parts = [self.select(postings, p) for p in formula[1]]
        return np.logical_and.reduce(parts) if formula[0] == "and" else np.logical_or.reduce(parts)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Boolean matrix (formula, text)."""
        p = self.postings(data, offsets)
        return np.vstack([self.select(p, f) for f in self.formulas])
