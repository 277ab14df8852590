"""Whether a file can be read as its language: a table-driven parse of the whole token stream.

One :class:`Reader` per language lives in each Python worker; tables come from the driver by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from sextant.llm.glr import Recogniser
from sextant.llm.lexers import ERROR, LEXERS, PlainLines
from sextant.llm.lr_tables import Tables

# Language by extension.
LANGUAGES = {".go": "go", ".py": "python", ".js": "javascript", ".java": "java", ".c": "c"}
#: Distinct lines that a process remembers before it begins anew, and the longest line that is remembered.
LINES, LONGEST = 300_000, 400
#: Longer token sequences are cut behind ; { } so that their parts can be looked up.
PART = 16


@dataclass
class Fault:
    line: int
    what: str


class Reader:
    def __init__(self, language: str, tables: Tables):
        self.language, self.tables = language, tables
        self.lexer = LEXERS[language]()
        self.plain = PlainLines(self.lexer)
        js = language == "javascript"
        self.rec = Recogniser(tables, "ASI" if js else None, ("}",) if js else ())
        self.names = {v: k for k, v in tables.terminals.items()}
        self.keys: dict[tuple, int] = {}
        self.parts: list[tuple[tuple[int, ...], bool]] = []
        self.seen: dict[tuple[object, str], tuple] = {}
        self.begin = ((0,),)
        get = tables.terminals.get
        self.ends, self.comma = {get(k) for k in (";", "{", "}")} - {None}, get(",")

    def _key(self, tokens: tuple[int, ...], fresh: bool) -> int:
        k = self.keys.get((tokens, fresh))
        if k is None:
            k = self.keys[(tokens, fresh)] = len(self.parts)
            self.parts.append((tokens, fresh))
        return k

    def _cut(self, kinds: list[str], fresh: bool = True) -> tuple[int, ...]:
        """Keys of a line's tokens, cut into parts."""
        get = self.tables.terminals.get
        numbers = [get(k, -1) for k in kinds]
        if len(numbers) <= PART:
            return (self._key(tuple(numbers), fresh),) if numbers else ()
        out, start, comma, ends = [], 0, self.comma, self.ends
        for at, k in enumerate(numbers):
            if k in ends or (k == comma and at - start >= PART - 1):
                out.append(self._key(tuple(numbers[start : at + 1]), fresh))
                start, fresh = at + 1, False
        if start < len(numbers):
            out.append(self._key(tuple(numbers[start:]), fresh))
        return tuple(out)

    def _feed(self, stacks, keys):
        """Stacks after the parts; None and the failing part if none is left."""
        feed, parts = self.rec.feed, self.parts
        for k in keys:
            tokens, fresh = parts[k]
            if len(stacks) == 1:
                after = feed(stacks[0], k, tokens, fresh)
            else:
                after = tuple(dict.fromkeys([x for s in stacks for x in feed(s, k, tokens, fresh)]))
            if not after:
                i = self.rec.first_error(stacks, tokens, fresh)
                return None, self.names.get(tokens[i], ERROR)
            stacks = after
        return stacks, ""

    def check(self, text: str, states: list | None = None) -> Fault | None:
        """The first token that no parse can take, or None.

        ``states``, if given, gets for each line whether it begins inside a comment, string or
        other open text (and for C also whether it lies in ``#if 0``).
        """
        if len(self.keys) > LINES:
            self.__init__(self.language, self.tables)
        lines = text.removeprefix("\ufeff").split("\n")
        return self._python(lines, states) if self.language == "python" else self._braces(lines, states)

    def _lexed(self, state, line: str):
        got = self.seen.get((state, line))
        if got is None:
            kinds, after = self.plain.line(state, line) or self.lexer.line(state, line)
            got = (self._cut(kinds), after)
            if len(line) <= LONGEST:
                if len(self.seen) > LINES:
                    self.seen.clear()
                self.seen[(state, line)] = got
        return got

    def _braces(self, lines: list[str], states: list | None = None) -> Fault | None:
        stacks, state, any_token = self.begin, self.lexer.start, False
        c = self.language == "c"
        seen, js = self.seen, self.language == "javascript"
        at, n = 0, len(lines)
        skips: list[list[bool]] = []  # C: (this branch is left out, a branch was taken, it is program text all the same)
        if js and lines[0].startswith("#!"):
            at = 1
        while at < n:
            line = lines[at]
            at += 1
            if states is not None:
                states += [True] * (at - 1 - len(states))
                states.append((state[0] if js else state) != "" or bool(skips and skips[-1][0] and not skips[-1][2]))
            if line and line[-1] == "\r":
                line = line[:-1]
            if c and (state == "" or state == "C"):
                while line.endswith("\\") and at < n:
                    line = line[:-1] + lines[at].removesuffix("\r")
                    at += 1
                if state == "" and "#" in line:
                    m = self.lexer.directive.match(line)
                    if m:
                        word = m.group(1)
                        if word not in self.lexer.directives:
                            if skips and skips[-1][0]:
                                continue
                            return Fault(at, "#" + word)
                        if word.startswith("if"):
                            off = bool(skips and skips[-1][0])
                            zero = word == "if" and line[m.end() :].strip() == "0"
                            skips.append([off or zero, off or not zero, off and skips[-1][2] and not zero])
                        elif word in ("else", "elif", "elifdef", "elifndef"):
                            if not skips:
                                return Fault(at, "#" + word)
                            outer = skips[-2] if len(skips) > 1 else (False, False, True)
                            zero = word == "elif" and line[m.end() :].strip() == "0"
                            skips[-1] = [skips[-1][1], True, not zero and (not outer[0] or outer[2])]
                        elif word == "endif":
                            if not skips:
                                return Fault(at, "#endif")
                            skips.pop()
                        else:
                            _, state = self.lexer.line("", line[m.end() :] if "/*" in line and '"' not in line else "")
                        continue
                if skips and skips[-1][0]:
                    if skips[-1][2] and states is not None:  # not parsed, but comments and strings are followed
                        state = (seen.get((state, line)) or self._lexed(state, line))[1]
                    continue
            got = seen.get((state, line))
            if got is None:
                got = self._lexed(state, line)
            keys, state = got
            if keys:
                any_token = True
                stacks, bad = self._feed(stacks, keys)
                if stacks is None:
                    return Fault(at, bad)
        if skips:
            return Fault(n, "#if without #endif")
        if (state[0] if js else state) != "":
            return Fault(n, "open comment or string at the end")
        if not any_token:
            return Fault(n, "no package clause") if self.language == "go" else None
        return None if self.rec.accepts(stacks) else Fault(n, "end of file")

    def _python(self, lines: list[str], states: list | None = None) -> Fault | None:
        stacks, state, depth, any_token = self.begin, "", 0, False
        indents, columns = [0], [0]
        seen = self.seen
        newline, indent, dedent = (self._cut([k]) for k in ("NEWLINE", "INDENT", "DEDENT"))
        open_line = False  # a logical line has begun
        for at, line in enumerate(lines, 1):
            if states is not None:
                states.append(open_line)
            if line and line[-1] == "\r":
                line = line[:-1]
            if "\0" in line:
                return Fault(at, "null byte")
            key = (("P", state), line)
            got = seen.get(key)
            if got is None:
                begin = "" if state == "K" else state
                kinds, after = self.plain.line(begin, line) or self.lexer.line(begin, line)
                count = kinds.count
                net = count("(") + count("[") + count("{") - count(")") - count("]") - count("}")
                body = line.lstrip(" \t\f")
                lead = line[: len(line) - len(body)].rpartition("\f")[2]
                wide = len(lead.expandtabs(8))
                got = (self._cut(kinds), after, net, wide, len(lead), bool(kinds) or after != "")
                if len(line) <= LONGEST:
                    if len(seen) > LINES:
                        seen.clear()
                    seen[key] = got
            keys, after, net, wide, narrow, any_here = got
            carried = state != ""
            state = after
            if not any_here and not carried:
                continue
            feed: tuple[int, ...] = ()
            if not open_line and any_here:
                if wide > indents[-1]:
                    if narrow <= columns[-1]:
                        return Fault(at, "inconsistent tabs")
                    indents.append(wide)
                    columns.append(narrow)
                    feed = indent
                else:
                    while wide < indents[-1]:
                        indents.pop()
                        columns.pop()
                        feed += dedent
                    if wide != indents[-1] or narrow != columns[-1]:
                        return Fault(at, "unindent matches no level")
                open_line = True
            depth += net
            if depth < 0:
                depth = 0
            feed += keys
            if open_line and depth == 0 and state == "":
                feed += newline
                open_line = False
            if feed:
                any_token = True
                stacks, bad = self._feed(stacks, feed)
                if stacks is None:
                    return Fault(at, bad)
        if isinstance(state, tuple) or state == "K":
            return Fault(len(lines), "open string at the end")
        if depth > 0 or open_line:
            return Fault(len(lines), "open bracket at the end")
        if not any_token:
            return None
        stacks, bad = self._feed(stacks, dedent * (len(indents) - 1))
        if stacks is None or not self.rec.accepts(stacks):
            return Fault(len(lines), bad or "end of file")
        return None
