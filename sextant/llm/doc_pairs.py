"""Functions paired with their documentation (problem 5).

Each file that can be read as its language is looked at once, next to the syntax check.  Comments and functions with a body are the two
sides of a bipartite graph.  A function's candidates are its docstring, the comment above it, comments further up behind blank lines,
the comment above the function before it if that is written for another, and the first comment of its body.  An edge costs what speaks against the link: distance,
parameter tags that the function lacks, the name of another function of the file at the beginning; tags that fit and the function's own name speak
for it.  Edges over ``LIMIT`` are implausible and rejected, as are comments that say nothing about the function (:func:`informative_words`,
:func:`is_code`).  A least-cost assignment, in which leaving a comment alone costs ``LIMIT``, links the rest.

:func:`linked_functions` gives every link with its place; :func:`documented_functions` those whose comment stands where documentation is
stated to be: the docstring in Python, else directly above, with only annotations and directives between.

Defined results: null contents, null paths, other extensions and files that do not parse give no pair; a file given
twice gives its pairs twice; functions without a body have none. Functions between ``#else`` and ``#endif`` of C count, those in ``#if 0`` do not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from sextant.llm.parse_check import all_tables, judged_files, reader

#: Words that a description has at least.
MIN_WORDS = 4
#: Cost from which a link is rejected, and blank lines over which a comment further up is looked for.
LIMIT, WINDOW = 2.5, 3

# Marks of tool directives, to-do marks, tags, and section titles.
DIRECTIVES = re.compile(
    r"(?://go:|//\s*\+build|//\s*nolint|//lint:|//export |//\s*(?:eslint|jshint|jslint|tslint|prettier|istanbul|c8|@ts-|ts-|sonar|NOSONAR|NOLINT|clang-format|cppcheck|"
    r"coverity|checkstyle|CHECKSTYLE|spotless|@formatter|region|endregion|#region|#endregion|noinspection|nosec|#nosec|webpack|@flow|flow|pragma|globals?\b|generated)|"
    r"/\*\s*(?:eslint|jshint|jslint|global|globals|istanbul|c8|prettier|webpack|@__|#__|NOLINT|clang-format|cppcheck|coverity|@ts-|LINTED|FALLTHROUGH)|#\s*(?:pragma|noqa|type:|pylint|fmt:))",
    re.I,
)
PLAIN_DIRECTIVE = re.compile(
    r"(?:go:\w+|nolint|lint:|eslint[-\w]*|jshint|jslint|tslint|prettier-ignore|istanbul|NOLINT\w*|NOSONAR|clang-format|cppcheck-suppress|noqa|pylint|pragma|type:|fmt:|"
    r"isort:|mypy:|ruff:|@ts-\w+|noinspection|nosec|coverage|checkstyle|\+build)\b.*$",
    re.I,
)
TODO = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b(?:\([^)]*\))?:?", re.I)
BRIEF = re.compile(r"^[@\\](?:brief|details|short|summary|description|desc)\b")
TAG = re.compile(r"^(?:[@\\][A-Za-z]\w*|:[A-Za-z]\w*[^:\n]*:|\.\. \w)")
SECTION = re.compile(
    r"^(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws|Attributes|Keyword Args|Keyword Arguments|Other Parameters|See Also|Inputs?|Outputs?)\s*:?\s*$",
    re.I,
)
INLINE_SECTION = re.compile(r"^(?:Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Throws)\s*:\s*\S", re.I)
RULE = re.compile(r"^[\W_]*$")
WORD = re.compile(r"[^\W\d_](?:[\w'’]*\w)?")


@dataclass
class Function:
    name: str
    line: int  # of the name, from 0
    top: int  # first line with annotations
    end: int  # last line, from 0
    signature: str
    params: list[str] = field(default_factory=list)
    body: int = 0  # line on which the body begins
    column: int = 0  # of its brace, while the end is not known (-1)


@dataclass
class Comment:
    start: int
    end: int
    text: str  # without marks, lines kept
    place: str = "above"  # or docstring, detached, other (above the function before), inside


# ------------------------------------------------------------------ descriptions


def name_words(name: str) -> set[str]:
    """The words of an identifier in lower case, and the identifier itself."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", name)
    return {p.lower() for p in parts} | {name.lower(), *[x.lower() for x in name.split("_") if x]}


def informative_words(text: str, name: str) -> list[str]:
    """Words of a description without tag lines and sections, rules, to-do marks, directives and the function's own words."""
    own, out, section = name_words(name), [], -1
    for raw in text.split("\n"):
        line = raw.strip()
        indent = len(raw) - len(raw.lstrip())
        if not line:
            section = -1
            continue
        if SECTION.match(line):
            section = indent
            continue
        if section >= 0 and (indent > section or re.match(r"[\w*]+(?:\s*\([^)]*\))?\s*:\s", line) or re.match(r"-{3,}$", line)):
            continue
        section = -1
        line = BRIEF.sub("", line).strip()
        if TAG.match(line) or INLINE_SECTION.match(line) or RULE.match(line) or PLAIN_DIRECTIVE.match(line):
            section = indent if TAG.match(line) else -1
            continue
        for w in WORD.findall(TODO.sub(" ", line)):
            if w.lower() not in own:
                out.append(w)
    return out


_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:return\b.*|[}\])]+.*|else:?|try:?)$|^[\w.\[\]*&]+\s*(?::=|[-+*/|&]?=)\s*\S|^(?:if|for|while|switch|elif|with)\b.*[:{]\s*$|^(?:var|let|const|int|char|def|func|function|import|from)\s+\w+.*[=({;:]"
    r"|^(?:if|while|for)\s*\(.*\)|^[\w.]+\(.*\)\s*;?\s*$|^(?:if|for)\b.*\{.*\}\s*$"
)


def is_code(text: str) -> bool:
    """True if the text is commented-out code: every line that is not empty looks like a statement."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return bool(lines) and sum(bool(_CODE_LINE.search(x)) for x in lines) >= max(1, 0.75 * len(lines))


def is_informative(text: str, name: str) -> bool:
    return len(informative_words(text, name)) >= MIN_WORDS and not is_code(text)


# ------------------------------------------------------------------ comments


def _stripped(lines: list[str], block: bool) -> str:
    out = []
    for i, line in enumerate(lines):
        s = line.strip()
        if block:
            if i == 0:
                s = re.sub(r"^/\*+!?", "", s)
            if i == len(lines) - 1:
                s = re.sub(r"\*+/$", "", s)
            s = re.sub(r"^\*+(?!/)\s?", "", s) if i else s
        else:
            s = re.sub(r"^//+[!<]?", "", s)
        out.append(s.removeprefix(" ").rstrip())
    return "\n".join(out)


def comments_above(lines: list[str], open_: list[bool], top: int) -> Comment | None:
    """The comment block that ends on the line above ``top``; directive lines on the way are stepped over."""
    at = top - 1
    while at >= 0 and not open_[at] and DIRECTIVES.match(lines[at].strip()) and (not lines[at].strip().startswith("/*") or lines[at].strip().endswith("*/")):
        at -= 1
    if at < 0:
        return None
    s = lines[at].strip()
    if not open_[at] and s.startswith("//"):
        end = at
        while at > 0 and not open_[at - 1] and lines[at - 1].strip().startswith("//"):
            at -= 1
        kept = [x for x in lines[at : end + 1] if not DIRECTIVES.match(x.strip())]
        return Comment(at, end, _stripped(kept, False)) if kept else None
    if s.endswith("*/"):
        end = at
        while at >= 0 and open_[at]:
            at -= 1
        if at >= 0 and lines[at].strip().startswith("/*"):
            return Comment(at, end, _stripped(lines[at : end + 1], True))
    return None


# ------------------------------------------------------------------ functions

_GO = re.compile(r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]")
_PY = re.compile(r"[ \t]*(?:async\s+)?def\s+(\w+)\s*[(\[]")
_JS = re.compile(
    r"\s*(?:(?:async\s+)?function\s*\*?\s*(?P<f>[\w$]+)\s*\("
    r"|(?:const|let|var)\s+(?P<c>[\w$]+)\s*=\s*(?:async\s+)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*=>|[\w$]+\s*=>|\($)"
    r"|(?:(?:static|async|get|set)\s+)*\*?\s*(?P<m>#?[\w$]+)\s*\([^;]*$)"
)
_JAVA = re.compile(
    r"\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^()=;]*>\s+)?"
    r"(?P<t>[\w.]+(?:\s*<[^()=;]*>)?(?:\s*\[\s*\])*)\s+(?P<n>\w+)\s*\("
)
_JAVA_CTOR = re.compile(r"\s*(?:public|private|protected)\s+(?P<n>[A-Z]\w*)\s*\(")
_C = re.compile(r"(?![#{}/*\s])(?!(?:return|else|if|for|while|switch|do|typedef|case|goto|struct\s+\w+\s*\{)\b)[\w\s*]*?[\s*](\w+)\s*\(")
_NOT_NAMES = frozenset("if for while switch catch return new else do try synchronized throw function super this with await typeof case assert yield in of".split())


def _close(lines: list[str], open_: list[bool], at: int, col: int, lexer) -> tuple[int, int] | None:
    """Line and column behind the bracket that closes the one at (at, col)."""
    depth = 0
    for ln in range(at, len(lines)):
        text = lines[ln]
        i = col if ln == at else 0
        for m in _BRACKETS.finditer(text, i):
            g = m.group()
            if g in "([{":
                depth += 1
            elif g in ")]}":
                depth -= 1
                if depth == 0:
                    return ln, m.end()
    return None


_BRACKETS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*|/\*.*?\*/|[()\[\]{}]")
_PY_BRACKETS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|#.*|[()\[\]{}:]")


def _param_names(signature: str, language: str) -> list[str]:
    inner = signature[signature.find("(") + 1 : signature.rfind(")")]
    names = []
    for p in inner.split(","):
        words = re.findall(r"[A-Za-z_$][\w$]*", p.split("=")[0].split(":")[0] if language in ("python", "javascript") else p.split("=")[0])
        if words:
            names.append(words[0] if language in ("go", "python", "javascript") else words[-1])
    return names


def _brace_functions(lines: list[str], open_: list[bool], language: str) -> Iterator[Function]:
    pattern = {"go": _GO, "javascript": _JS, "java": _JAVA, "c": _C}[language]
    for at, line in enumerate(lines):
        if open_[at] or "(" not in line:
            continue
        m = pattern.match(line) or (_JAVA_CTOR.match(line) if language == "java" else None)
        if not m:
            continue
        if language == "javascript":
            kind = m.lastgroup
            name = m.group(kind)
        elif language == "java":
            kind, name = "", m.group("n")
            if "t" in m.groupdict() and m.groupdict()["t"] in _NOT_NAMES | {"else", "throw", "return", "new"}:
                continue
        else:
            kind, name = "", m.group(1)
        if name in _NOT_NAMES:
            continue
        column = line.index(name, m.start(kind) if kind else line.index(name)) + len(name)
        if language == "go":
            column = m.end() - 1
        paren = line.find("(", column)
        if language == "go" and line[column] == "[":
            after = _close(lines, open_, at, column, None)
            if not after:
                continue
            at2, paren = after[0], lines[after[0]].find("(", after[1])
        else:
            at2 = at
        if kind == "c":  # a constant that holds a function
            eq = line.index("=", column)
            rest = line[eq + 1 :].strip()
            if not rest.startswith(("function", "async", "(")):
                end_sig = (at, line.index("=>", eq))
            else:
                if paren < 0:
                    continue
                end_sig = _close(lines, open_, at, line.index("(", eq), None)
            if not end_sig:
                continue
            tail = lines[end_sig[0]][end_sig[1] :]
            if "=>" in tail and not tail.split("=>", 1)[1].strip().startswith("{"):
                yield Function(name, at, at, end_sig[0], " ".join(x.strip() for x in lines[at : end_sig[0] + 1]), _param_names(line[eq:], language), end_sig[0])
                continue
            if not rest.startswith(("function", "async function", "async")) and "=>" not in tail:
                continue
        else:
            if paren < 0:
                continue
            end_sig = _close(lines, open_, at2, paren, None)
            if not end_sig:
                continue
        # what stands between the parameters and the body
        ln, col = end_sig
        between: list[str] = []
        while ln < len(lines):
            piece = re.sub(r"//.*|/\*.*?\*/", "", lines[ln][col:])
            cut = piece.find("{")
            between.append(piece if cut < 0 else piece[:cut])
            if cut >= 0:
                col += lines[ln][col:].index("{")
                break
            if ";" in piece and (language != "c" or not _old_style(between)) or "}" in piece or (language == "go" and not re.search(r"[(,]\s*$", piece)):
                ln = -1
                break
            ln, col = ln + 1, 0
        if ln < 0 or ln >= len(lines):
            continue
        between = " ".join(between).strip()
        if language == "javascript" and between not in ("", "=>"):
            continue
        if language == "java" and between and not between.startswith("throws") and not re.fullmatch(r"[\[\]\s]+", between):
            continue
        if language == "c" and between and not re.fullmatch(r"(?:__\w+.*|[\w\s*,;\[\]]+)", between):
            continue
        if language == "go" and re.search(r"\b(?:interface|struct)\s*$", between):  # a result type with braces
            inner = _close(lines, open_, ln, col, None)
            if not inner or "{" not in lines[inner[0]][inner[1] :]:
                continue
            ln, col = inner[0], lines[inner[0]].index("{", inner[1])
        top = at
        while top > 0 and not open_[top - 1]:
            above = lines[top - 1].strip()
            if language in ("java", "javascript") and re.match(r"@\w+(?:\.\w+)*(?:\(.*\))?$", above):
                top -= 1
            elif language == "c" and (re.match(r"(?:__attribute__|\[\[|#\s*pragma)", above) or (re.fullmatch(r"(?:static|inline|extern|const|unsigned|struct|void|int|char|long|size_t|[\w*]+_t)(?:[\s*]+\w+)*[\s*]*", above) and not line[:1].isspace())):
                top -= 1
            else:
                break
        yield Function(name.lstrip("#"), at, top, -1, " ".join(x.strip() for x in lines[at : ln + 1]), _param_names(" ".join(lines[at2 : end_sig[0] + 1]), language), ln, col)


def end_of(f: Function, lines: list[str], open_: list[bool]) -> int:
    """The last line of a function; brackets are followed only where it is asked for."""
    if f.end < 0:
        stop = _close(lines, open_, f.body, f.column, None)
        f.end = stop[0] if stop else f.body
    return f.end


def _old_style(between: list[str]) -> bool:
    """True if what follows C parameters declares them, one type and name after the other, and so belongs to a definition."""
    text = " ".join(between).strip()
    return bool(re.fullmatch(r"(?:(?:const |unsigned |signed |struct |register )*[A-Za-z_]\w*[\s*]+[\w\s*,\[\]]+;\s*)+", text))


_DOC_QUOTE = re.compile(r"[ \t]*[rRuU]?(\"\"\"|'''|\"|')")


def _docstring(lines: list[str], at: int, col: int) -> tuple[int, int, str] | None:
    """A string literal that is a statement of its own from (at, col): its lines and text."""
    m = _DOC_QUOTE.match(lines[at], col)
    if not m:
        return None
    q, parts, ln, i = m.group(1), [], at, m.end()
    raw = "r" in m.group().lower().split(q)[0]
    while ln < len(lines):
        text = lines[ln]
        j, buf = i, []
        while j < len(text):
            if text[j] == "\\":
                buf.append(text[j : j + 2] if raw else text[j + 1 : j + 2])
                j += 2
            elif text.startswith(q, j):
                rest = text[j + len(q) :].split("#")[0].strip().rstrip(";")
                parts.append("".join(buf))
                return (at, ln, "\n".join(parts)) if not rest else None
            else:
                buf.append(text[j])
                j += 1
        if len(q) == 1:
            return None
        parts.append("".join(buf))
        ln, i = ln + 1, 0
    return None


def _python_functions(lines: list[str], open_: list[bool]) -> Iterator[tuple[Function, Comment | None]]:
    for at, line in enumerate(lines):
        if open_[at] or "def" not in line:
            continue
        m = _PY.match(line)
        if not m:
            continue
        depth, ln, col, found = 0, at, m.end() - 1, None
        while ln < len(lines) and found is None:
            for x in _PY_BRACKETS.finditer(lines[ln], col):
                g = x.group()
                if g in "([{":
                    depth += 1
                elif g in ")]}":
                    depth -= 1
                elif g == ":" and depth == 0:
                    found = (ln, x.end())
                    break
            ln, col = ln + 1, 0
        if not found:
            continue
        sig = " ".join(x.strip() for x in lines[at : found[0] + 1])
        rest = lines[found[0]][found[1] :]
        indent = len(line) - len(line.lstrip())
        body = found[0] + 1
        doc = None
        if rest.split("#")[0].strip():
            doc = _docstring(lines, found[0], found[1])
            body = found[0]
        else:
            while body < len(lines) and (not lines[body].strip() or lines[body].lstrip().startswith("#")):
                body += 1
            if body < len(lines):
                doc = _docstring(lines, body, 0)
        end = body
        for k in range(body + 1, len(lines)):
            if lines[k].strip() and not open_[k] and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                break
            if lines[k].strip():
                end = k
        top = at
        while top > 0 and not open_[top - 1] and lines[top - 1].lstrip().startswith("@"):
            top -= 1
        fn = Function(m.group(1), at, top, end, sig, _param_names(sig, "python"), body)
        yield fn, Comment(doc[0], doc[1], doc[2], "docstring") if doc else None


# ------------------------------------------------------------------ candidates

_TAGS = re.compile(r"(?:[@\\]param(?:\[\w+\])?|:param)\s+(?:\{[^}]*\}\s*|[A-Za-z_][\w.]*\s+(?=\w+:))?[*&]*(\w+)")
_FIRST = re.compile(r"[^\w]*(?:[@\\]brief\s+)?([\w$]+)")


def _hashes_above(lines: list[str], open_: list[bool], top: int) -> Comment | None:
    """The block of Python comments that ends on the line above ``top``."""
    at = top
    while at > 0 and not open_[at - 1] and lines[at - 1].lstrip().startswith("#"):
        at -= 1
    if at == top:
        return None
    return Comment(at, top - 1, "\n".join(re.sub(r"^\s*#+ ?", "", x) for x in lines[at:top]))


def _above(lines: list[str], open_: list[bool], top: int, language: str) -> Comment | None:
    return _hashes_above(lines, open_, top) if language == "python" else comments_above(lines, open_, top)


def _detached(lines: list[str], open_: list[bool], top: int, language: str) -> Comment | None:
    """The comment above one to ``WINDOW`` blank lines above ``top``."""
    at = top
    while at > 0 and top - at < WINDOW and not open_[at - 1] and not lines[at - 1].strip():
        at -= 1
    c = _above(lines, open_, at, language) if at < top else None
    if c:
        c.place = "detached"
    return c


def _inside(lines: list[str], open_: list[bool], f: Function, language: str) -> Comment | None:
    """The comment that the body begins with."""
    at = f.body + (0 if language == "python" else 1)
    if language == "python":  # comments before the first statement
        while at > f.line and lines[at - 1].lstrip().startswith("#"):
            at -= 1
    mark = "#" if language == "python" else "/"
    stop = at
    if at >= len(lines) or not lines[at].lstrip().startswith(mark):
        return None
    while stop <= end_of(f, lines, open_) and stop < len(lines) and (lines[stop].lstrip().startswith(mark) or open_[stop]):
        stop += 1
    c = _above(lines, open_, stop, language) if stop > at else None
    if c and c.start >= at:
        c.place = "inside"
        return c
    return None


def foreign(c: Comment, f: Function, names: frozenset[str]) -> bool:
    """True if a comment looks written for another function: it begins with another's name, or has tags of which none fits."""
    first = _FIRST.match(c.text)
    if first and first.group(1) != f.name and first.group(1) in names:
        return True
    tags = _TAGS.findall(c.text) if "param" in c.text else ()
    return bool(tags) and not any(t in f.params for t in tags)


def link_cost(c: Comment, f: Function, names: frozenset[str] = frozenset()) -> float | None:
    """Cost of a link, None if it is implausible. ``names``: of the file's functions."""
    cost = 0.0
    if c.place == "detached":
        cost += 2.75 + 0.25 * (f.top - 1 - c.end)
    elif c.place == "other":
        cost += 4.0
    elif c.place == "inside":
        cost += 3.5
    tags = _TAGS.findall(c.text) if "param" in c.text else ()
    if tags:
        fit = sum(t in f.params for t in tags)
        cost += min(1.5, 0.5 * (len(tags) - fit)) - min(1.5, 0.75 * fit)
    first = _FIRST.match(c.text)
    if first and first.group(1) == f.name:
        cost -= 2.5
    elif first and first.group(1) in names:
        cost += 1.5
    elif f.name in c.text:
        cost -= 1.0
    if c.place in ("above", "docstring"):  # where documentation stands a link is always plausible
        return min(cost, LIMIT - 0.25)
    return cost if cost < LIMIT else None


def edges_of(functions: list[Function], own: dict[int, Comment], lines: list[str], open_: list[bool], language: str) -> tuple[list[Comment], dict[tuple[int, int], float], dict[tuple[int, int], str]]:
    """Comments, the costs of plausible links (comment, function), and where the comment stands for the function. ``own``: comments that stand where documentation should.

    Only functions whose own comment says nothing about them, or is missing, or looks written for another, look further.
    """
    names = frozenset(f.name for f in functions)
    order: list[Comment] = []
    index: dict[tuple[int, int], int] = {}
    edges: dict[tuple[int, int], float] = {}
    places: dict[tuple[int, int], str] = {}

    def edge(c: Comment | None, k: int) -> None:
        if c is None or not is_informative(c.text, functions[k].name):
            return
        cost = link_cost(c, functions[k], names)
        if cost is not None:
            at = index.setdefault((c.start, c.end), len(index))
            if at == len(order):
                order.append(c)
            if cost < edges.get((at, k), LIMIT):
                edges[(at, k)], places[(at, k)] = cost, c.place

    strange: Comment | None = None  # the comment above the function before, if it looks written for another
    for k, f in enumerate(functions):
        c = own.get(k)
        edge(c, k)
        odd = c is not None and foreign(c, f, names)
        if c is None or odd or (index.get((c.start, c.end)), k) not in edges:
            if c is None or c.place == "docstring":
                if language == "python":
                    near = _above(lines, open_, f.top, language)
                    if near:
                        near.place = "detached"
                    edge(near, k)
                edge(_detached(lines, open_, f.top, language), k)
            else:
                edge(_detached(lines, open_, c.start, language), k)
            if strange is not None:
                edge(Comment(strange.start, strange.end, strange.text, "other"), k)
            if c is None or c.place != "docstring":
                edge(_inside(lines, open_, f, language), k)
        strange = c if odd else None
    return order, edges, places


# ------------------------------------------------------------------ assignment


def assign(edges: dict[tuple[int, int], float], alone: float = LIMIT) -> list[tuple[int, int]]:
    """Least-cost assignment of comments to functions, in which a comment may be left alone at the cost ``alone`` (shortest augmenting paths)."""
    by_left: dict[int, list[int]] = {}
    degree: dict[int, int] = {}
    for a, b in edges:
        by_left.setdefault(a, []).append(b)
        degree[b] = degree.get(b, 0) + 1
    holder: dict[int, int] = {}  # function -> comment
    for a in sorted(by_left):
        if len(by_left[a]) == 1 and degree[by_left[a][0]] == 1:  # nothing to choose
            if edges[(a, by_left[a][0])] < alone:
                holder[by_left[a][0]] = a
            continue
        # cheapest way to place ``a``: along alternating paths to a free function, or to a comment that is left alone instead
        dist, back, waiting = {a: 0.0}, {a: None}, [a]
        best, last, dropped = alone, None, a
        while waiting:
            x = waiting.pop()
            for b in by_left[x]:
                y = holder.get(b)
                if y == x:
                    continue
                d = dist[x] + edges[(x, b)]
                if y is None:
                    if d < best - 1e-12:
                        best, last, dropped = d, (x, b), None
                    continue
                d -= edges[(y, b)]
                if d < dist.get(y, float("inf")) - 1e-12:
                    dist[y], back[y] = d, (x, b)
                    waiting.append(y)
                    if d + alone < best - 1e-12:
                        best, last, dropped = d + alone, None, y
        step = back[dropped] if dropped is not None else last
        while step is not None:
            x, b = step
            holder[b] = x
            step = back[x]
    return sorted((a, b) for b, a in holder.items())


def pairs_of(text: str, language: str, open_: list[bool]) -> Iterator[tuple[Function, Comment]]:
    """Linked and informative pairs of one file. ``open_``: which lines begin inside a comment or string."""
    lines = [x.removesuffix("\r") for x in text.removeprefix("\ufeff").split("\n")]
    open_ = open_ + [False] * (len(lines) - len(open_))
    functions: list[Function] = []
    own: dict[int, Comment] = {}
    if language == "python":
        for f, c in _python_functions(lines, open_):
            if c:
                own[len(functions)] = c
            functions.append(f)
    else:
        for f in _brace_functions(lines, open_, language):
            if c := comments_above(lines, open_, f.top):
                own[len(functions)] = c
            functions.append(f)
    order, edges, places = edges_of(functions, own, lines, open_, language)
    for a, b in assign(edges):
        end_of(functions[b], lines, open_)
        yield functions[b], Comment(order[a].start, order[a].end, order[a].text, places[(a, b)])


def linked_functions(files: DataFrame) -> DataFrame:
    """(path, lang, fn_name, line_start, line_end, signature, doc, code, place) of every link in ``files`` (path, content).

    ``place``: docstring, above, detached (behind blank lines; in Python any comment above), other (above the function before) or inside.
    """
    tables = all_tables(files.sparkSession)
    names = ["path", "lang", "fn_name", "line_start", "line_end", "signature", "doc", "code", "place"]
    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 4
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for path, lang, text in zip(*(b[c].to_pylist() for c in ("path", "lang", "content")), strict=True):
                open_: list[bool] = []
                if reader(lang, tables).check(text, open_) is not None:
                    continue
                lines = text.split("\n")
                for f, c in pairs_of(text, lang, open_):
                    row = (path, lang, f.name, f.line + 1, f.end + 1, f.signature, c.text.strip(), "\n".join(lines[f.line : f.end + 1]), c.place)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema=schema)

    return judged_files(files).mapInArrow(
        extract, "path string, lang string, fn_name string, line_start int, line_end int, signature string, doc string, code string, place string"
    )


def documented_functions(files: DataFrame) -> DataFrame:
    """The links whose comment is a docstring or stands directly above, without the column ``place``."""
    return linked_functions(files).filter("place in ('docstring', 'above')").drop("place")
