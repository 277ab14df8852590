"""Line-by-line lexers: (state, line) gives token kinds and the next state.

Working by line lets equal lines be looked up instead of read again; what reaches over a line end (block
comments, raw strings, templates, brackets) is held in the state.  A kind is a terminal of the bundled grammar, or
``ERROR`` for what no token begins with.  A lexer may also say where comments lie, for operators that need them.
"""

from __future__ import annotations

import re

ERROR = "ERROR"

# Reserved words of the languages.
GO_WORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range "
    "return select struct switch type var".split()
)
C_WORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register "
    "restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic "
    "_Bool _Complex _Generic _Noreturn _Static_assert _Thread_local typeof asm __attribute__ __builtin_va_arg "
    "__builtin_offsetof".split()
)
C_ALIASES = {
    "__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__volatile__": "volatile", "__const": "const", "__asm__": "asm",
    "__typeof__": "typeof", "static_assert": "_Static_assert", "__extension__": "const", "bool": "_Bool",
}
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected "
    "public return short static strictfp super switch synchronized this throw throws transient try void volatile while true "
    "false null record permits sealed yield when module requires exports opens uses provides open".split()
)
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else extends false finally for function if in "
    "instanceof new null return super switch this throw true try typeof var void while with import async of get set static let yield await".split()
)
JS_RESERVED = frozenset("enum export".split())
PY_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if "
    "import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
)

_C_NUMBER = re.compile(
    r"(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01']+|\d[\d']*(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[uUlLfF]*$"
)
_GO_NUMBER = re.compile(r"(?:0[xX][_\da-fA-F]+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO]?[0-7_]*|[1-9][\d_]*|\d[\d_]*\.[\d_]*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)i?$")
_JAVA_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[lLfFdD]?$")
_JS_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|\d[\d_]*n|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)$")
_PY_NUMBER = re.compile(
    r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|0[0_]*|[1-9][\d_]*|(?:\d[\d_]*\.[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[jJ]?|\d[\d_]*[eE][+-]?\d[\d_]*[jJ]?|\d[\d_]*[jJ])$"
)
_WORDS = r"[^\W\d]\w*"
_PP_NUMBER = r"\.?\d(?:[eEpP][+-](?=\d)|[\w.])*"


class Lexer:
    """A language with C-like comments. ``master``: groups W word, N number, S string, C character, P punctuation."""

    start: object = ""
    words: frozenset[str] = frozenset()
    aliases: dict[str, str] = {}
    number = _C_NUMBER
    master: re.Pattern
    splices = False

    def _comment_end(self, line: str, at: int):
        end = line.find("*/", at)
        return end + 2 if end >= 0 else -1

    def line(self, state, line: str) -> tuple[list[str], object]:
        """Kinds of a line's tokens and the state after it. State: '' or 'C' (in a block comment)."""
        kinds: list[str] = []
        at, n = 0, len(line)
        if state == "C":
            at = self._comment_end(line, 0)
            if at < 0:
                return kinds, "C"
        match, words, aliases = self.master.match, self.words, self.aliases
        while at < n:
            m = match(line, at)
            if m is None:
                kinds.append(ERROR)
                return kinds, ""
            at = m.end()
            g = m.lastgroup
            if g == "W":
                w = m.group()
                w = aliases.get(w, w)
                kinds.append(w if w in words else "ID")
            elif g == "P":
                kinds.append(m.group())
            elif g == "N":
                kinds.append("NUM" if self.number.match(m.group()) else ERROR)
            elif g == "S":
                kinds.append("STR")
            elif g == "C":
                kinds.append("CHR")
            elif g == "O":
                at = self._comment_end(line, at)
                if at < 0:
                    return kinds, "C"
        return kinds, ""


def _master(strings: str, chars: str, punctuation: str) -> re.Pattern:
    return re.compile(
        rf"(?:[ \t\f\v\r\ufeff]+)|(?:\/\/.*)|(?P<O>\/\*)|{strings}|{chars}|(?P<W>{_WORDS})|(?P<N>{_PP_NUMBER})|(?P<P>{punctuation})"
    )


class CLexer(Lexer):
    words, aliases = C_WORDS, C_ALIASES
    splices = True
    master = _master(
        r'(?P<S>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*")', r"(?P<C>(?:[uUL])?'(?:[^'\\\n]|\\.)+')",
        r"\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|[<>=!*/%+\-&^|]=|&&|\|\||[{}()\[\];,.<>=!~*/%+\-&^|?:]",
    )
    directive = re.compile(r"[ \t]*#[ \t]*(\w*)")
    # Preprocessor directives.
    directives = frozenset("define undef include include_next import if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident".split()) | {""}


class GoLexer(Lexer):
    words, number = GO_WORDS, _GO_NUMBER
    # A raw string may stay open at the line end.
    master = re.compile(
        r"(?:[ \t\r\ufeff]+)|(?:\/\/.*)|(?P<O>\/\*)|(?P<S>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))*\"|`[^`]*`)|(?P<R>`)"
        r"|(?P<C>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))')"
        rf"|(?P<W>{_WORDS})|(?P<N>{_PP_NUMBER})"
        r"|(?P<P>\.\.\.|&\^=|<<=|>>=|:=|<-|\+\+|--|<<|>>|&\^|[<>=!*/%+\-&^|]=|&&|\|\||[{}()\[\];,.<>=!~*/%+\-&^|:])"
    )
    # Tokens after which a line end counts as a semicolon.
    enders = frozenset(["ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])

    def line(self, state, line):
        kinds: list[str] = []
        at, n = 0, len(line)
        if state == "R":
            end = line.find("`")
            if end < 0:
                return kinds, "R"
            kinds.append("STR")
            at = end + 1
        elif state == "C":
            at = self._comment_end(line, 0)
            if at < 0:
                return kinds, "C"
        match, words, state = self.master.match, self.words, ""
        while at < n:
            m = match(line, at)
            if m is None:
                kinds.append(ERROR)
                return kinds, ""
            at, g = m.end(), m.lastgroup
            if g == "W":
                w = m.group()
                kinds.append(w if w in words else "ID")
            elif g == "P":
                kinds.append(m.group())
            elif g == "N":
                kinds.append("NUM" if self.number.match(m.group()) else ERROR)
            elif g == "S":
                kinds.append("STR")
            elif g == "C":
                kinds.append("CHR")
            elif g == "O":
                at = self._comment_end(line, at)
                if at < 0:
                    state = "C"
                    break
            elif g == "R":
                return kinds, "R"
        if kinds and kinds[-1] in self.enders:
            kinds.append(";")
        return kinds, state


class JavaLexer(Lexer):
    words, number = JAVA_WORDS, _JAVA_NUMBER
    escape = r"\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[\da-fA-F]{4})"
    master = re.compile(
        rf"(?:[ \t\f\r\ufeff]+)|(?:\/\/.*)|(?P<O>\/\*)|(?P<T>\"\"\"[ \t\f]*$)|(?P<S>\"(?:[^\"\\\n]|{escape})*\")|(?P<C>'(?:[^'\\\n]|{escape})')"
        rf"|(?P<W>non-sealed\b|(?:{_WORDS}|\$)[\w$]*)|(?P<N>{_PP_NUMBER})"
        r"|(?P<P>\.\.\.|>>>=|<<=|>>=|->|::|\+\+|--|<<|[<>=!*/%+\-&^|]=|&&|\|\||[{}()\[\];,.<>=!~*/%+\-&^|?:@])"
    )

    def line(self, state, line):
        if state == "T":
            at = re.match(r'(?:[^"\\]|\\.|"(?!""))*', line).end()
            if line[at : at + 3] != '"""':
                return [], "T"
            kinds, state = self.line("", line[at + 3 :])
            return ["STR", *kinds], state
        m = re.search(r'"""[ \t\f]*$', line) if '"""' in line and state == "" else None
        if m:
            kinds, after = super().line(state, line[: m.start()])
            return kinds, "T" if after == "" else after
        kinds, state = super().line(state, line)
        return [k if k != "non-sealed" else "non-sealed" for k in kinds], state

    aliases: dict[str, str] = {}


JavaLexer.words = JAVA_WORDS | {"non-sealed"}


class JsLexer(Lexer):
    """State: (mode, open templates, whether the last token ends a value). Modes: '', 'C' comment, 'T' template."""

    start = ("", (), False)
    words, number = JS_WORDS, _JS_NUMBER
    master = re.compile(
        r"(?:[ \t\f\v\r\xa0\ufeff]+)|(?:\/\/.*)|(?P<O>\/\*)|(?P<S>\"(?:[^\"\\\n]|\\.)*(?:\"|\\$)|'(?:[^'\\\n]|\\.)*(?:'|\\$))|(?P<B>`)"
        rf"|(?P<V>#(?:{_WORDS}|\$)[\w$]*)|(?P<W>(?:{_WORDS}|\$)[\w$]*)|(?P<N>\.?\d(?:[eE][+-](?=\d)|[\w.])*)"
        r"|(?P<P>\.\.\.|>>>=|=>|\?\.(?!\d)|\?\?=|\?\?|\*\*=|\*\*|===|!==|<<=|>>>|>>=|&&=|\|\|=|\+\+|--|<<|>>|[<>=!*/%+\-&^|]=|&&|\|\||[{}()\[\];,.<>=!~*/%+\-&^|?:])"
    )
    regex = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
    chars = re.compile(r"(?:[^`\\$]|\\(?:.|$)|\$(?!\{))*")
    values = frozenset(["ID", "NUM", "STR", "REGEX", "TFULL", "TTAIL", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "NLINC", "async", "of", "get", "set", "static", "let", "PRIVATE"])
    # Words after which a line end is a semicolon.
    cutters = frozenset(["return", "break", "continue"])

    def line(self, state, line):
        mode, open_, value = state
        kinds: list[str] = []
        at, n = 0, len(line)
        if mode == "C":
            at = self._comment_end(line, 0)
            if at < 0:
                return kinds, state
        elif mode == "T":
            at = self._template(line, 0, kinds, head=open_[-1] == 0)
            if at < 0:
                return kinds, state
            open_ = open_[:-1] + (1,) if kinds[-1] in ("THEAD", "TMID") else open_[:-1]
            value = kinds[-1] in self.values
        if mode == "S":  # a string carried on over the line end by a backslash
            m = re.match(r'(?:[^"\'\\]|\\.)*(?:["\']|\\$)', line)
            if not m:
                return [ERROR], ("", open_, False)
            if m.group().endswith("\\"):
                return kinds, state
            at, value = m.end(), True
            kinds.append("STR")
        match, words, values = self.master.match, self.words, self.values
        conditions: list[bool] = []  # for each bracket opened on this line, whether a statement follows it
        while at < n:
            m = match(line, at)
            if m is None:
                kinds.append(ERROR)
                return kinds, ("", open_, False)
            g = m.lastgroup
            start, at = at, m.end()
            if g is None:
                continue
            if g == "W":
                w = m.group()
                kind = w if w in words else "KEYWORD" if w in JS_RESERVED else "ID"
            elif g == "P":
                kind = m.group()
                if kind in ("/", "/=") and not value:
                    r = self.regex.match(line, start)
                    if not r:
                        kinds.append(ERROR)
                        return kinds, ("", open_, False)
                    at, kind = r.end(), "REGEX"
                elif kind == "{":
                    if open_:
                        open_ = (*open_[:-1], open_[-1] + 1)
                elif kind == "}" and open_:
                    if open_[-1] == 1:
                        at = self._template(line, at, kinds, head=False)
                        if at < 0:
                            return kinds, ("T", (*open_[:-1], -1), False)
                        if kinds[-1] == "TTAIL":
                            open_ = open_[:-1]
                        value = kinds[-1] in values
                        continue
                    open_ = (*open_[:-1], open_[-1] - 1)
                elif kind in ("++", "--") and not kinds:
                    kind = "NLINC"
            elif g == "N":
                kind = "NUM" if self.number.match(m.group()) else ERROR
            elif g == "S":
                if m.group().endswith("\\"):
                    return kinds, ("S", open_, False)
                kind = "STR"
            elif g == "V":
                kind = "PRIVATE"
            elif g == "B":
                at = self._template(line, at, kinds, head=True)
                if at < 0:
                    return kinds, ("T", (*open_, 0), False)
                if kinds[-1] == "THEAD":
                    open_ = (*open_, 1)
                value = kinds[-1] in values
                continue
            else:
                at = self._comment_end(line, at)
                if at < 0:
                    return self._cut(kinds), ("C", open_, value)
                continue
            if kind == "(":
                conditions.append(bool(kinds) and kinds[-1] in ("if", "while", "for", "with") and kinds[-2:-1] not in (["."], ["?."]))
            kinds.append(kind)
            value = kind in values
            if kind == ")" and conditions and conditions.pop():
                value = False
        return self._cut(kinds), ("", open_, value)

    def _cut(self, kinds):
        if kinds and kinds[-1] in self.cutters:
            kinds.append("ASI")
        return kinds

    def _template(self, line: str, at: int, kinds: list[str], head: bool) -> int:
        """Reads template characters; -1 if the template stays open at the line end."""
        at = self.chars.match(line, at).end()
        if at >= len(line):
            return -1
        if line[at] == "`":
            kinds.append("TFULL" if head else "TTAIL")
            return at + 1
        kinds.append("THEAD" if head else "TMID")
        return at + 2


class PyLexer:
    """State: '' or the quotes of an open string with its prefix. Indentation and brackets are the reader's."""

    start: object = ""
    opener = re.compile(r"(?P<pre>[A-Za-z]{0,2})(?P<q>\"\"\"|'''|\"|')")
    # String prefixes.
    prefixes = frozenset(["", "r", "b", "u", "f", "rb", "br", "fr", "rf"])
    master = re.compile(
        rf"(?:[ \t\f]+)|(?:#.*)|(?P<Q>[A-Za-z]{{0,2}}[\"'])|(?P<W>{_WORDS})|(?P<N>\.?\d(?:[eE][+-](?=\d)|[\w.])*)|(?P<K>\\$)"
        r"|(?P<P>\.\.\.|\*\*=|//=|>>=|<<=|->|:=|\*\*|//|<<|>>|[<>=!*/%+\-&^|@]=|[{}()\[\];,.<>=~*/%+\-&^|:@])"
    )
    body = {
        q: re.compile(rf"(?:[^\\{q[0]}]|\\.|\\$" + (rf"|{q[0]}(?!{q[0]}{q[0]})" if len(q) == 3 else "") + r")*") for q in ('"', "'", '"""', "'''")
    }

    def line(self, state, line: str) -> tuple[list[str], object]:
        """State after: '' , 'K' (carried on by a backslash), or (quotes, formatted) of an open string."""
        kinds: list[str] = []
        at, n = 0, len(line)
        if isinstance(state, tuple):
            q, _ = state
            at = self.body[q].match(line, 0).end()
            if not line.startswith(q, at):
                if len(q) == 1 and not (line.endswith("\\") and at >= n):
                    return [ERROR], ""
                return kinds, state
            kinds.append("STR")
            at += len(q)
        match = self.master.match
        while at < n:
            m = match(line, at)
            if m is None:
                kinds.append(ERROR)
                return kinds, ""
            start, at, g = at, m.end(), m.lastgroup
            if g == "W":
                w = m.group()
                kinds.append(w if w in PY_WORDS else "ID")
            elif g == "P":
                kinds.append(m.group())
            elif g == "N":
                kinds.append("NUM" if _PY_NUMBER.match(m.group()) else ERROR)
            elif g == "Q":
                o = self.opener.match(line, start)
                pre, q = o["pre"].lower(), o["q"]
                if pre not in self.prefixes:
                    kinds.append(ERROR)
                    return kinds, ""
                at = o.end()
                if "f" in pre and len(q) == 1:
                    at = self._formatted(line, at, q, kinds, "r" in pre)
                    if at < 0:
                        kinds.append(ERROR)
                        return kinds, ""
                    continue
                at = self.body[q].match(line, at).end()
                if line.startswith(q, at):
                    at += len(q)
                    kinds.append("STR")
                elif len(q) == 3 or line.endswith("\\"):
                    return kinds, (q, "f" in pre)
                else:
                    kinds.append(ERROR)
                    return kinds, ""
            elif g == "K":
                return kinds, "K"
        return kinds, ""

    def _formatted(self, line: str, at: int, q: str, kinds: list[str], raw: bool) -> int:
        """Reads a formatted string of one line after its quote; -1 if it is broken."""
        kinds.append("FSTART")
        at = self._parts(line, at, q, kinds, False, raw)
        if at < 0 or not line.startswith(q, at):
            return -1
        kinds.append("FEND")
        return at + len(q)

    def _parts(self, line: str, at: int, q: str, kinds: list[str], spec: bool, raw: bool) -> int:
        n = len(line)
        while at < n:
            c = line[at]
            if c == "\\":
                if not raw and line.startswith("N{", at + 1):  # a character by its name
                    end = line.find("}", at)
                    if end < 0:
                        return -1
                    at = end + 1
                else:  # a backslash does not take the meaning from a brace
                    at += 1 if line[at + 1 : at + 2] in ("{", "}") else 2
            elif line.startswith(q, at) or (spec and c == "}"):
                return at
            elif c == "{":
                if not spec and line.startswith("{{", at):
                    at += 2
                    continue
                at = self._field(line, at + 1, q, kinds, raw)
                if at < 0:
                    return -1
            elif c == "}":
                if not line.startswith("}}", at):
                    return -1
                at += 2
            else:
                at += 1
        return -1

    def _field(self, line: str, at: int, q: str, kinds: list[str], raw: bool) -> int:
        kinds.append("FLB")
        depth, n, match = 0, len(line), self.master.match
        while at < n:
            if depth == 0 and line[at] == "}":
                kinds.append("FRB")
                return at + 1
            if depth == 0 and line[at] == "!" and line[at + 1 : at + 2] != "=":
                m = re.match(r"![rsa]", line[at : at + 2])
                if not m:
                    return -1
                kinds.append("FCONV")
                at += 2
                continue
            if depth == 0 and line[at] == ":":
                kinds.append("FCOLON")
                at = self._parts(line, at + 1, q, kinds, True, raw)
                if at < 0 or line[at : at + 1] != "}":
                    return -1
                continue
            m = match(line, at)
            if m is None or m.group().startswith("#"):
                return -1
            g, text = m.lastgroup, m.group()
            if g == "Q":
                o = self.opener.match(line, at)
                inner = o["q"]
                if len(inner) == 3:
                    return -1
                if "f" in o["pre"].lower():
                    at = self._formatted(line, o.end(), inner, kinds, "r" in o["pre"].lower())
                    if at < 0:
                        return -1
                    continue
                end = self.body[inner].match(line, o.end()).end()
                if not line.startswith(inner, end):
                    return -1
                kinds.append("STR")
                at = end + 1
                continue
            at = m.end()
            if g == "W":
                kinds.append(text if text in PY_WORDS else "ID")
            elif g == "N":
                kinds.append("NUM")
            elif g == "P":
                depth += (text in "([{") - (text in ")]}")
                kinds.append(text)
        return -1


LEXERS = {"c": CLexer, "go": GoLexer, "java": JavaLexer, "javascript": JsLexer, "python": PyLexer}


# ------------------------------------------------------------------ plain lines


class _Kinds(dict):
    """Kind of a token by its text, worked out once; '' for comments, None for what only the full lexer can tell."""

    def __init__(self, lexer, limit: int = 300_000):
        super().__init__()
        self.lexer, self.limit = lexer, limit

    def __missing__(self, token: str):
        if len(self) > self.limit:
            self.clear()
        kind = self[token] = self._kind(token)
        return kind

    def _kind(self, token: str):
        lexer = self.lexer
        if isinstance(lexer, PyLexer):
            o = lexer.opener.match(token)
            if o:
                pre = o["pre"].lower()
                whole = len(token) > o.end() and token.endswith(o["q"])
                return "STR" if whole and pre in lexer.prefixes and "f" not in pre and len(o["q"]) == 1 else None
            if token[0] == "#":
                return ""
        elif token.startswith("//"):
            return ""
        m = lexer.master.match(token)
        if m is None or m.end() != len(token):
            return None
        g = m.lastgroup
        if g == "W":
            words = PY_WORDS if isinstance(lexer, PyLexer) else lexer.words
            w = token if isinstance(lexer, PyLexer) else lexer.aliases.get(token, token)
            return w if w in words else None if w in JS_RESERVED and isinstance(lexer, JsLexer) else "ID"
        if g == "P":
            return token
        if g == "N":
            number = _PY_NUMBER if isinstance(lexer, PyLexer) else lexer.number
            return "NUM" if number.match(token) else None
        return {"S": "STR", "C": "CHR", "V": "PRIVATE"}.get(g)


class PlainLines:
    """Kinds of lines without anything that reaches beyond them, from one ``findall``: the usual line.

    Gives None for every other line, which the full lexer then reads.
    """

    def __init__(self, lexer):
        self.lexer, self.kinds = lexer, _Kinds(lexer)
        if isinstance(lexer, PyLexer):
            tail = lexer.master.pattern.split("(?P<W>", 1)[1]
            body = r"#.*|[A-Za-z]{0,2}(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<W>" + tail
            self.stops = ('"""', "'''")
        else:
            body = lexer.master.pattern
            self.stops = {JsLexer: ("/", "`"), JavaLexer: ("/*", '"""')}.get(type(lexer), ("/*", "`"))
        self.find = re.compile(r"[ \t\f\v\r﻿\xa0]+|(" + re.sub(r"\(\?P<\w>", "(?:", body) + r"|\S)").findall

    def line(self, state, line: str) -> tuple[list[str], object] | None:
        lexer = self.lexer
        js = isinstance(lexer, JsLexer)
        if js:
            if state[0] or state[1]:
                return None
        elif state != "":
            return None
        if line[-1:] == "\\":
            return None
        for s in self.stops:
            if s in line:
                return None
        known = self.kinds
        out = [known[t] for t in self.find(line) if t]
        if None in out:
            return None
        if "" in out:
            out = [k for k in out if k]
        if js:
            if out and out[0] in ("++", "--"):
                out[0] = "NLINC"
            value = out[-1] in lexer.values if out else state[2]
            return lexer._cut(out), ("", (), value)
        if isinstance(lexer, GoLexer) and out and out[-1] in lexer.enders:
            out.append(";")
        return out, ""
