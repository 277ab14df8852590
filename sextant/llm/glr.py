"""A table-driven recogniser that keeps every possible parse stack and remembers what a line of tokens does.

What a sequence of tokens does to a stack depends only on the states that it uncovers, so the effect
of each distinct (sequence, uncovered states) is worked out once per process and looked up afterwards:
most lines of source code repeat the shape of an earlier line.
"""

from __future__ import annotations

from sextant.llm.lr_tables import END, Tables

#: Distinct effects that a process remembers before it begins anew.
MEMORY = 400_000


class Recogniser:
    def __init__(self, tables: Tables, asi: str | None = None, closers: tuple[str, ...] = ()):
        """``asi``: terminal that may be slipped in before a token that cannot follow, if that token
        begins a line, is one of ``closers``, or is the end."""
        self.t = tables
        self.end = tables.terminals[END]
        self.asi = tables.terminals[asi] if asi else None
        self.closers = {tables.terminals[c] for c in closers} | {self.end}
        self.memo: dict[tuple[int, int], list[tuple[int, dict]]] = {}
        self.entries = 0

    def _shift(self, stack: tuple[int, ...], token: int, low: list[int]) -> list[tuple[int, ...]]:
        """All stacks after ``token``; low[0]: the shortest stack whose top was looked at."""
        actions, gotos = self.t.actions, self.t.gotos
        out, work, seen = [], [stack], None
        while work:
            s = work.pop()
            for n, x in actions[s[-1]].get(token, ()):
                if n == 0:
                    out.append((*s, x))
                    continue
                base = s[:-n]
                if len(base) < low[0]:
                    low[0] = len(base)
                to = gotos[base[-1]].get(x)
                if to is None:
                    continue
                new = (*base, to)
                if seen is None:
                    seen = {new}
                elif new in seen:
                    continue
                else:
                    seen.add(new)
                work.append(new)
        return out

    def _run(self, stack: tuple[int, ...], tokens: tuple[int, ...], fresh_line: bool, low: list[int]) -> tuple[list[tuple[int, ...]], int]:
        """Stacks after all tokens, and the index of the token at which none was left (or -1)."""
        stacks = [stack]
        for i, token in enumerate(tokens):
            after: list[tuple[int, ...]] = []
            for s in stacks:
                got = self._shift(s, token, low)
                if not got and self.asi is not None and ((i == 0 and fresh_line) or token in self.closers):
                    for s2 in self._shift(s, self.asi, low):
                        got += self._shift(s2, token, low)
                after += got
            if not after:
                return [], i
            stacks = list(dict.fromkeys(after)) if len(after) > 1 else after
        return stacks, -1

    def feed(self, stack: tuple[int, ...], key: int, tokens: tuple[int, ...], fresh_line: bool) -> tuple[tuple[int, ...], ...]:
        """Stacks after a line. ``key``: a number that stands for (tokens, fresh_line)."""
        known = self.memo.get((key, stack[-1]))
        if known:
            for d, by in known:
                found = by.get(stack[-d:])
                if found is not None:
                    if d == len(stack):
                        return found
                    head = stack[:-d]
                    return tuple([head + f for f in found])
        low = [len(stack)]
        out, _ = self._run(stack, tokens, fresh_line, low)
        cut = low[0] - 1
        d = len(stack) - cut
        found = tuple([s[cut:] for s in out])
        if self.entries > MEMORY:
            self.memo.clear()
            self.entries = 0
        known = self.memo.setdefault((key, stack[-1]), [])
        by = next((b for n, b in known if n == d), None)
        if by is None:
            by = {}
            known.append((d, by))
        by[stack[-d:]] = found
        self.entries += 1
        return tuple(out)

    def first_error(self, stacks, tokens, fresh_line: bool) -> int:
        """Index of the token that no stack can take."""
        return max(self._run(s, tokens, fresh_line, [len(s)])[1] for s in stacks)

    def accepts(self, stacks) -> bool:
        for s in stacks:
            if any(x[-1] == -1 for x in self._run(s, (self.end,), True, [len(s)])[0]):
                return True
        return False
