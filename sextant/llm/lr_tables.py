"""Parse tables from a bundled grammar: LR(0) states with FOLLOW sets as look-ahead.

A grammar is text: ``name: alternatives ;`` with quoted or upper-case terminals, groups in
parentheses and the marks ``?``, ``*`` and ``+``.  Conflicts stay in the tables: the recogniser follows all
of them side by side.  ``%over A B : 'x'`` lets rules A win over rules B where both could begin with
the terminal x (a block over an object literal at the start of a statement).
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from importlib import resources

END = "END"
_TOKEN = re.compile(r"\s+|#[^\n]*|('(?:[^'\\]|\\.)+'|%?\w+|[:;|()?*+])")


@dataclass
class Tables:
    """Per state: actions by terminal number (shifts as (0, state), reductions as (length, lhs)), and gotos."""

    terminals: dict[str, int]
    actions: list[dict[int, tuple[tuple[int, int], ...]]]
    gotos: list[dict[int, int]]


def _parse(text: str):
    tokens = [m.group(1) for m in _TOKEN.finditer(text) if m.group(1)]
    rules: dict[str, set[tuple[str, ...]]] = defaultdict(set)
    order: list[str] = []
    over: list[tuple[set[str], set[str], set[str]]] = []
    at = 0
    made: dict[object, str] = {}

    def fresh(key) -> str:
        if key not in made:
            made[key] = f"<_{len(made)}"
        return made[key]

    def symbol(token: str) -> str:
        """Terminals as they are, rule names with a mark."""
        return token[1:-1] if token[0] == "'" else token if token[0].isupper() else f"<{token}"

    def alternatives() -> list[tuple[str, ...]]:
        nonlocal at
        out = sequence()
        while tokens[at] == "|":
            at += 1
            out = out + sequence()
        return out

    def sequence() -> list[tuple[str, ...]]:
        nonlocal at
        seqs: list[tuple[str, ...]] = [()]
        while tokens[at] not in (";", "|", ")"):
            if tokens[at] == "(":
                at += 1
                part = alternatives()
                at += 1
            else:
                part = [(symbol(tokens[at]),)]
                at += 1
            mark = tokens[at] if tokens[at] in ("?", "*", "+") else ""
            at += bool(mark)
            if mark in ("*", "+"):
                key = ("+", tuple(part))
                new = key not in made
                name = fresh(key)
                if new:
                    for p in part:
                        rules[name].add(p)
                        rules[name].add((name, *p))
                part = [(name,)]
            if mark in ("?", "*"):
                part = [(), *part]
            elif len(part) > 3:  # a group used once more is a rule of its own
                key = ("|", tuple(part))
                name = fresh(key)
                rules[name] |= set(part)
                part = [(name,)]
            seqs = [s + p for s in seqs for p in part]
        return seqs

    while at < len(tokens):
        if tokens[at] == "%over":
            end = tokens.index(";", at)
            colon = tokens.index(":", at)
            over.append(({symbol(tokens[at + 1])}, {symbol(t) for t in tokens[at + 2 : colon]}, {symbol(t) for t in tokens[colon + 1 : end]}))
            at = end + 1
            continue
        name = symbol(tokens[at])
        order.append(name)
        at += 2
        rules[name] |= set(alternatives())
        at += 1
    return order[0], rules, over


def build(text: str) -> Tables:
    """Tables of a grammar; the first rule is the start."""
    start, rules, over = _parse(text)
    flat: list[tuple[str, tuple[str, ...]]] = [("_start", (start,))]
    by_lhs: dict[str, list[int]] = defaultdict(list)
    for lhs in sorted(rules):
        for rhs in sorted(rules[lhs]):
            if rhs == (lhs,):
                continue
            by_lhs[lhs].append(len(flat))
            flat.append((lhs, rhs))
    names = set(by_lhs)
    if lost := {s for _, r in flat for s in r if s[0] == "<" and len(s) > 3 and s[1].isalpha() and s not in names}:
        raise ValueError(f"undefined symbols: {sorted(lost)}")

    nullable = set()
    changed = True
    while changed:
        changed = False
        for lhs, rhs in flat:
            if lhs not in nullable and all(s in nullable for s in rhs):
                nullable.add(lhs)
                changed = True
    first: dict[str, set[str]] = defaultdict(set)
    follow: dict[str, set[str]] = defaultdict(set)
    follow[start].add(END)
    changed = True
    while changed:
        changed = False
        for lhs, rhs in flat:
            for s in rhs:
                new = first[s] if s in names else {s}
                if not new <= first[lhs]:
                    first[lhs] |= new
                    changed = True
                if s not in nullable:
                    break
    changed = True
    while changed:
        changed = False
        for lhs, rhs in flat:
            tail = follow[lhs]
            for s in reversed(rhs):
                if s in names:
                    if not tail <= follow[s]:
                        follow[s] |= tail
                        changed = True
                    tail = (tail | first[s]) if s in nullable else first[s]
                else:
                    tail = {s}

    # Rules that a dot before a symbol brings in, by symbol.
    direct = {a: {flat[r][1][0] for r in by_lhs[a] if flat[r][1] and flat[r][1][0] in names} for a in names}
    for a in names:  # symbols behind nullable ones
        for r in by_lhs[a]:
            for s in flat[r][1]:
                if s in names:
                    direct[a].add(s)
                if s not in nullable:
                    break
    closed: dict[str, frozenset[int]] = {}
    for a in names:
        seen, todo = {a}, [a]
        while todo:
            for s in direct[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        closed[a] = frozenset(r for s in seen for r in by_lhs[s])

    numbers = {t: i for i, t in enumerate(sorted({s for _, r in flat for s in r if s not in names} | {END}))}
    lhs_no = {a: i for i, a in enumerate(sorted(names | {"_start"}))}
    kernels = {((0, 0),): 0}
    queue, actions, gotos = [((0, 0),)], [], []
    for kernel in queue:
        moves: dict[str, set[tuple[int, int]]] = defaultdict(set)
        acts: dict[int, set[tuple[int, int]]] = defaultdict(set)
        seen_rules: set[int] = set()
        items = list(kernel)
        for r, d in kernel:
            rhs = flat[r][1]
            while d < len(rhs) and rhs[d] in names:
                seen_rules |= closed[rhs[d]]
                if rhs[d] not in nullable:
                    break
                d += 1
        items += [(r, 0) for r in seen_rules if (r, 0) not in kernel]
        for r, d in items:
            lhs, rhs = flat[r]
            if d < len(rhs):
                moves[rhs[d]].add((r, d + 1))
            elif r == 0:
                acts[numbers[END]].add((0, -1))
            else:
                for t in follow[lhs]:
                    acts[numbers[t]].add((len(rhs), lhs_no[lhs]))
        goto = {}
        for s in sorted(moves):
            to = moves[s]
            for winners, losers, terms in over:
                if s in terms and any(flat[r][0] in winners for r, _ in to):
                    to = {x for x in to if flat[x[0]][0] not in losers}
            k = tuple(sorted(to))
            if k not in kernels:
                kernels[k] = len(queue)
                queue.append(k)
            if s in names:
                goto[lhs_no[s]] = kernels[k]
            else:
                acts[numbers[s]].add((0, kernels[k]))
        actions.append({t: tuple(sorted(a)) for t, a in acts.items()})
        gotos.append(goto)
    # A reduction of an empty rule has length 0 too: such rules are kept out of grammars but for the start.
    return Tables(numbers, actions, gotos)


def load(language: str) -> Tables:
    """Tables of a bundled grammar."""
    return build((resources.files("sextant.llm") / "grammars" / f"{language}.txt").read_text(encoding="utf-8"))
