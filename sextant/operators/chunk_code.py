"""Functions, methods and types of source files as chunks.

Comments and strings are blanked (same length) before declarations are looked for, so that brackets match; bodies end at
the matching bracket, in Ruby at the matching ``end``, in Python where the syntax tree or the indentation says.  Each
declaration is emitted once.  Approximations: a declaration must begin its line; macros and templates of C++ are not expanded.

Defined results: null contents and unknown languages give no chunk; a file that cannot be read gives what could be found.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import spread

SCHEMA = (
    "file_path string, language string, chunk_type string, name string, signature string, receiver string, doc_comment string, code string, "
    "line_start int, line_end int, metadata map<string,string>"
)

_C_LIKE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_BACKTICK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_GO_TEXT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'", re.S)
_PHP = re.compile(r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", re.S)
_RUBY = re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_MASKS = {"go": _GO_TEXT, "javascript": _BACKTICK, "typescript": _BACKTICK, "rust": _RUST, "php": _PHP, "ruby": _RUBY}

_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|async|export|override|implicit|sealed|case|pub(?:\([^)]*\))?|unsafe|const|extern|inline|virtual|constexpr|explicit|readonly)\s+)*"
# Which declarations of a language become which chunk type.
_RULES: dict[str, list[tuple[str, re.Pattern]]] = {
    lang: [(kind, re.compile(p, re.M)) for kind, p in rules]
    for lang, rules in {
        "javascript": [
            ("class", rf"^[ \t]*{_MODS}class\s+(?P<name>[\w$]+)"),
            ("function", rf"^[ \t]*(?:export\s+default\s+)?{_MODS}function\s*\*?\s*(?P<name>[\w$]+)\s*(?P<sig>\([^{{;]*)"),
            ("function", rf"^[ \t]*{_MODS}(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?P<sig>\([^;{{]*?\)\s*(?::[^=\n]+)?)=>"),
            ("method", rf"^[ \t]+{_MODS}(?:get\s+|set\s+|\*\s*)?(?P<name>(?!(?:if|for|while|switch|catch|return|function|with)\b)[\w$#]+)\s*(?P<sig>\([^;{{}}]*\)[^;{{}}=]*)(?=\{{)"),
        ],
        "java": [
            ("class", rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}class\s+(?P<name>\w+)"),
            ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>\w+)"),
            ("method", rf"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*{_MODS}(?:<[^>]+>\s+)?(?!(?:new|return|throw|else|case|public|private|protected|static|final)\b)[\w.]+(?:<[^;(]*>)?(?:\[\])*\s+(?P<name>(?!(?:if|for|while|switch|catch)\b)\w+)\s*(?P<sig>\([^;{{}}]*\)[^;{{}}=]*)(?=\{{)"),
            ("function", rf"^[ \t]*(?:public|private|protected)\s+(?P<name>[A-Z]\w*)\s*(?P<sig>\([^;{{}}]*\)[^;{{}}]*)(?=\{{)"),
        ],
        "rust": [
            ("function", rf"^[ \t]*{_MODS}fn\s+(?P<name>\w+)(?P<sig>[^{{;]*)"),
            ("struct", rf"^[ \t]*{_MODS}struct\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MODS}enum\s+(?P<name>\w+)"),
            ("interface", rf"^[ \t]*{_MODS}trait\s+(?P<name>\w+)"), ("impl", r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"),
        ],
        "c": [
            ("struct", r"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*(?=\{)"), ("enum", r"^[ \t]*(?:typedef\s+)?enum\s+(?P<name>\w+)\s*(?=\{)"),
            ("class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)[^;{]*(?=\{)"),
            ("function", rf"^(?![ \t]*(?:else|return|typedef|struct\s+\w+\s*\{{)\b){_MODS}[\w:<>,*&~ \t]*?[\w:*&>~ \t](?P<name>(?!(?:if|for|while|switch|catch|return)\b)~?\w+)\s*(?P<sig>\([^;{{}}]*\)[^;{{}}=]*)(?=\{{)"),
        ],
        "php": [
            ("class", rf"^[ \t]*{_MODS}class\s+(?P<name>\w+)"), ("interface", r"^[ \t]*(?:interface|trait)\s+(?P<name>\w+)"),
            ("function", r"^function\s+&?(?P<name>\w+)\s*(?P<sig>\([^{;]*)"), ("method", rf"^[ \t]+{_MODS}function\s+&?(?P<name>\w+)\s*(?P<sig>\([^{{;]*)"),
        ],
        "scala": [
            ("class", rf"^[ \t]*{_MODS}(?:class|object)\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_MODS}trait\s+(?P<name>\w+)"),
            ("function", rf"^[ \t]*{_MODS}def\s+(?P<name>\w+)(?P<sig>[^={{\n]*)"),
        ],
    }.items()
}
_RULES["typescript"], _RULES["cpp"] = _RULES["javascript"], _RULES["c"]
#: Languages that have a chunker.
LANGUAGES = ("go", "python", "ruby", *_RULES)


def masked(text: str, language: str) -> str:
    """The text with comments and strings blanked; line ends stay."""
    return _MASKS.get(language, _C_LIKE).sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def closing(mask: str, at: int) -> int:
    """Index behind the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}()\[\]]").finditer(mask, at):
        depth += 1 if m.group() in "{([" else -1
        if depth == 0:
            return m.end()
    return len(mask)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _doc_before(text: str, at: int) -> str:
    """The comment right before a declaration, without its marks: only the last line of a row of line comments. Blank lines may stand between."""
    line = text.rfind("\n", 0, at) + 1
    if text[line:at].strip():
        return ""
    before = text[:line].rstrip()
    last = before.rsplit("\n", 1)[-1].strip()
    if last.startswith("//"):
        return last.removeprefix("//").strip()
    if last.startswith("#"):
        return last
    if last.endswith("*/"):
        start = before.rfind("/*")
        return before[start:].removeprefix("/*").removesuffix("*/").strip() if start >= 0 else ""
    return ""


def _row(text: str, start: int, end: int, kind: str, name: str, **more) -> dict:
    return {
        "chunk_type": kind, "name": name, "signature": "", "receiver": "", "doc_comment": _doc_before(text, start), "code": text[start:end],
        "line_start": _line(text, start), "line_end": _line(text, max(start, end - 1)), "metadata": {},
    } | more


# ------------------------------------------------------------------ languages


def _go(text: str) -> Iterator[dict]:
    mask = masked(text, "go")
    meta = {}
    if m := re.search(r"^package\s+(\w+)", mask, re.M):
        meta["package"] = m.group(1)
    imports = []
    for m in re.finditer(r"^import\s+(?:\(|(?:\w+\s+|\.\s+)?(?=\"|`|\s))", mask, re.M):
        end = closing(mask, m.end() - 1) if mask[m.end() - 1] == "(" else (text.find("\n", m.end()) + len(text)) % len(text)
        imports += re.findall(r"\"([^\"\n]*)\"", text[m.start() : end])
    if imports:
        meta["imports"] = ", ".join(imports)
    rows = []
    for m in re.finditer(r"^func\s+(?:(?P<recv>\([^)]*\))\s*)?(?P<name>\w+)\s*(?=[(\[])", mask, re.M):
        at = m.end()
        if mask[at] == "[":
            at = closing(mask, at)
        after = closing(mask, mask.find("(", at))
        line_end = mask.find("\n", after)
        line_end = len(mask) if line_end < 0 else line_end
        rest = mask[after:line_end]
        if rest.lstrip().startswith("("):
            r_end = closing(mask, mask.find("(", after))
            rest_end = r_end
            line_end = mask.find("\n", r_end) if mask.find("\n", r_end) >= 0 else len(mask)
        else:
            brace = re.search(r"(?<!interface)(?<!struct)\{", re.sub(r"(interface|struct)\s+\{", lambda x: x.group().replace(" ", "_"), rest))
            rest_end = after + (brace.start() if brace else len(rest))
        body = mask.find("{", rest_end, line_end)
        end = closing(mask, body) if body >= 0 else rest_end
        signature = " ".join(text[at:rest_end].split())
        recv = (m.group("recv") or "").strip("()").split()
        receiver = recv[1] if len(recv) > 1 else recv[0] if recv else ""
        kind = "method" if m.group("recv") else "function"
        rows.append(_row(text, m.start(), end, kind, m.group("name"), signature=signature, receiver=receiver))
    for m in re.finditer(r"^type\s+(?P<group>\()?", mask, re.M):
        end = closing(mask, m.end() - 1) if m.group("group") else len(mask)
        spec = re.compile(r"(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\s*(?=\{)", re.M)
        at = m.end()
        while s := spec.search(mask, at, end):
            if not m.group("group") and mask[m.end() : s.start()].strip():
                break
            stop = closing(mask, mask.find("{", s.end("kind")))
            inner = mask[mask.find("{", s.end("kind")) + 1 : stop - 1]
            extra = {}
            names = []
            for line in re.sub(r"\{[^{}]*\}", "", inner).split("\n"):
                words = line.strip()
                f = re.match(r"(\w+)\s*\(", words) if s.group("kind") == "interface" else re.match(r"(\w+)(?:\s*,\s*\w+)*\s+[\w*\[\]({.<-]", words)
                if f:
                    names.append(f.group(1))
            if names:
                extra["methods" if s.group("kind") == "interface" else "fields"] = ", ".join(names)
            span = (m.start(), end) if m.group("group") else (m.start(), stop)
            rows.append(_row(text, *span, s.group("kind"), s.group("name"), metadata=extra, _at=s.start()))
            at = stop
            if not m.group("group"):
                break
    for r in sorted(rows, key=lambda r: (r["line_start"], r.pop("_at", 0))):
        r["metadata"] = r["metadata"] | meta
        yield r


def _python(text: str) -> Iterator[dict]:
    lines = text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield from _python_by_indent(text, lines)
        return
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, kinds)), key=lambda n: n.lineno):
        code = "\n".join(lines[node.lineno - 1 : node.end_lineno])[node.col_offset :]
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        at = sum(map(len, lines[: node.lineno - 1])) + node.lineno - 1
        doc = "" if node.decorator_list else _doc_before(text, at + node.col_offset)
        said = ast.get_docstring(node, clean=False)
        sig = "" if kind == "class" else f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        yield {
            "chunk_type": kind, "name": node.name, "signature": sig, "receiver": "", "doc_comment": doc, "code": code,
            "line_start": node.lineno, "line_end": node.end_lineno, "metadata": {"docstring": said} if said else {},
        }


def _python_by_indent(text: str, lines: list[str]) -> Iterator[dict]:
    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)\s*(\(.*?\))?", line)
        if not m:
            continue
        end = i
        for k in range(i + 1, len(lines)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= len(m.group(1)):
                break
            if lines[k].strip():
                end = k
        code = "\n".join(lines[i : end + 1])[len(m.group(1)) :]
        yield {
            "chunk_type": "class" if m.group(2) == "class" else "function", "name": m.group(3), "signature": (m.group(4) or "") if m.group(2) == "def" else "", "receiver": "",
            "doc_comment": "", "code": code, "line_start": i + 1, "line_end": end + 1, "metadata": {},
        }


def _ruby(text: str) -> Iterator[dict]:
    mask = masked(text, "ruby")
    lines = mask.split("\n")
    opens = re.compile(r"(?:^|[;=])\s*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
    for i, line in enumerate(lines):
        m = re.match(r"\s*(def|class|module)\s+(?P<name>[\w:?!=]+)(?P<sig>\([^)]*\))?", line)
        if not m or re.match(r"\s*def\s+self\.", line):
            continue
        depth, end = 0, len(lines) - 1
        for k in range(i, len(lines)):
            depth += len(opens.findall(lines[k])) - len(re.findall(r"(?:^|[;\s])end\b", lines[k]))
            if depth <= 0:
                end = k
                break
        start = sum(len(x) + 1 for x in text.split("\n")[:i]) + len(line) - len(line.lstrip())
        stop = sum(len(x) + 1 for x in text.split("\n")[: end + 1]) - 1
        yield _row(text, start, stop, "method" if m.group(1) == "def" else m.group(1), m.group("name"), signature=m.group("sig") or "")


def _braces(text: str, language: str) -> Iterator[dict]:
    mask = masked(text, language)
    seen: set[int] = set()
    rows = []
    for kind, pattern in _RULES[language]:
        for m in pattern.finditer(mask):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if start in seen:
                continue
            seen.add(start)
            stop = re.compile(r"[{;]|=(?!=)" if language != "scala" else r"[{\n]").search(mask, m.end())
            brace = mask.find("{", m.end())
            if kind == "function" and "=>" in m.group()[-2:]:
                semi = mask.find(";", m.end())
                end = closing(mask, brace) if 0 <= brace and not mask[m.end() : brace].strip() else (semi + 1 if semi >= 0 else len(mask))
            elif stop and stop.group() == "{":
                end = closing(mask, stop.start())
            elif stop:
                end = stop.end() if stop.group() == ";" else mask.find("\n", stop.start()) if mask.find("\n", stop.start()) >= 0 else len(mask)
            else:
                end = len(mask)
            sig = m.groupdict().get("sig")
            name = m.group("name")
            rows.append(_row(text, start, end, kind, name, signature=" ".join(text[m.start("sig") : m.end("sig")].split()) if sig else ""))
    return iter(sorted(rows, key=lambda r: (r["line_start"], -r["line_end"])))


def extract(text: str, language: str) -> list[dict]:
    """Chunks of one file in source order."""
    if language == "go":
        found = _go(text)
    elif language == "python":
        found = _python(text)
    elif language == "ruby":
        found = _ruby(text)
    elif language in _RULES:
        found = _braces(text, language)
    else:
        return []
    out = list(found)
    for r in out:
        r["metadata"] = {k: v for k, v in (r["metadata"] | {"language": language}).items() if v}
    return out


def chunk_code(files: DataFrame) -> DataFrame:
    """Chunks of ``files`` (path, language, content); files are independent, so nothing is shuffled."""
    names = [c.strip().split(" ")[0] for c in SCHEMA.replace("map<string,string>", "map").split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [r | {"file_path": path, "language": lang} for path, lang, text in zip(p["path"], p["language"], p["content"], strict=True) for r in extract(text, lang)]
            yield pd.DataFrame(rows, columns=names)

    known = files.filter("content IS NOT NULL AND language IS NOT NULL").select("path", "language", "content")
    return spread(known).mapInPandas(run, SCHEMA)


def with_ids(chunks: DataFrame) -> DataFrame:
    """Deterministic ids from path, place and text."""
    place = F.concat_ws("\x1f", "file_path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), F.coalesce("name", F.lit("")), F.sha2("code", 256))
    return chunks.withColumn("chunk_id", F.sha2(place, 256))
