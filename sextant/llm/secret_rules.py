"""Detection rules for written-out credentials: each a regex over one chunk, and what a live value looks like.

Every rule has the group ``v``, the value's span.  ``needs`` lists texts (lower case) of which each
match holds at least one per entry: the trigram index is asked for them before the regex runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# ------------------------------------------------------------------ fixed values

#: Words that make a name a credential's name when they end it.
SECRET_TAILS = (
    "password passwd passphrase passwort kennwort passcode pwd pw pass psw contrasena contraseña senha motdepasse mdp secret secrets token "
    "apikey accesskey secretkey authkey auth bearer credential credentials cred creds pat jwt pem"
).split()
#: Words before ``key`` that make it a credential; ``key`` alone is a credential only in prose.
KEY_KINDS = (
    "api access auth authorization secret private signing sign hmac license licence material encryption encrypt crypto "
    "master shared session service storage account deploy webhook client app application aes rsa ssh jwt token cipher root admin staging temp subscription seed "
    "consumer instrumentation server write read ingest publish"
).split()
#: Words that, at the end of a name, make it something else.
NOT_SECRET_TAILS = (
    "label file ttl digest checksum etag commit id part hash path url uri name type kind count limit length len size field hint prompt placeholder "
    "title text format pattern regex env var variable public expiry expires header version status policy policies max min rotation"
).split()
#: Prefixes of issued tokens.
TOKEN_PREFIXES = (
    r"gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-(?:live-|test-|proj-)?|[sr]k_live_|sk_test_|brk_pat_|qvx_live_|fnk-|LMT\.|AKIA|ASIA|AIza|ya29\.|npm_|pypi-|"
    r"hf_|dop_v1_|SG\.|shpat_|eyJ"
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-+|_+|#+|0+|1234\w*|abc\w{0,3}|n/?a|none|null|nil|undefined|true|false|empty|unset|todo|tbd|fixme|secret|password|passwd|token|key|"
    r"passphrase|credentials?|user(?:name)?|redacted|masked|hidden|removed|dummy|sample|test|foo|bar|foobar|default|string|value|required|optional|yes|no|basic|bearer)$"
    r"|change.?(?:me|it|this)|replace.?(?:me|this|with)|your[_\- ]|my[_\- ](?:secret|password|token|api)|<[^>]*>|\$\{|\$\(|\{\{|\}\}|%\(|%[sv]\b|\{\w*\}|"
    r"placeholder|insert[_\- ]|enter[_\- ]|put[_\- ]|fill[_\- ]|goes[_\- ]?here|_here$|-here$|example|x{6,}|\*{4,}|•{3,}|\[redacted\]|not[_\- ]?(?:set|real|a)[_\- ]|^x-[a-z]+-[a-z]+$"
)
REFERENCE = re.compile(
    r"(?i)^(?:vault:|secret/|secrets/|kv/|env[:.]|env\(|file:|ssm:|arn:|aws:|gcp:|keyring:|op://|keychain:|ref\+|!|\$[A-Za-z_{(]|/(?:run|etc|var|home|opt|srv|usr|mnt|secrets?)/|"
    r"\.{0,2}/|~/|https?://[^@]*$|(?:os|process)\.(?:env|getenv)|sha\d{1,3}[:-]|md5[:-]|ssh-(?:rsa|ed25519|dss)\b|ecdsa-|data:|-----BEGIN PUB|base64:|urn:|@)"
)
#: Name words that are hashes, revisions and the like even if a credential's word comes before them.
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zßäöüñçéè]+|\d+")


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(name)]


def is_secret_name(name: str) -> bool:
    """True if the words at the end of a name call it a credential."""
    w = name_words(name)
    while w and (w[-1].isdigit() or w[-1] in ("value", "val", "str", "string", "default", "raw", "old", "new", "literal")):
        w.pop()
    if not w:
        return False
    last = w[-1]
    if last in SECRET_TAILS or any(last.endswith(t) for t in ("password", "passwd", "secret", "apikey", "passphrase", "kennwort")):
        return True
    if last == "key" and len(w) > 1 and w[-2] in KEY_KINDS:
        return True
    return False


_HEX = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32,64})$")


def is_live(value: str, quoted: bool = True) -> bool:
    """Whether a value could work as it stands: no placeholder, mask, reference, label or plain word."""
    v = value.strip()
    if len(v) < 6 or any(c.isspace() for c in v):
        return False
    if v[-1] in ":,(" or PLACEHOLDER.search(v) or REFERENCE.match(v):
        return False
    if len(set(v)) < 4 or re.fullmatch(r"[\d.,]+", v) and len(v) < 10:
        return False
    if re.fullmatch(r"[A-Za-z]+", v):  # one word, or letters in mixed case
        return len(v) >= 8 and not re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]{3,})*|[A-Z]+", v)
    return True


#: Names of passwords, whose values people make up: words and phrases may stand there.
_MADE_UP = re.compile(r"(?i)(?:pass(?:word|wd|phrase|wort|code)|kennwort|pwd|contraseña|motdepasse)\d*$")
_SENTENCE = frozenset("a an and any are at be by can enter for from has here if in is it its must my new no not of on or our please the their this to use user was with you your password passphrase passwd secret token key".split())


def is_made_up(name: str, value: str) -> bool:
    """Whether the value of a password's name could be one that a person made up: one long word, or a phrase that is no sentence."""
    if not _MADE_UP.search(name) or PLACEHOLDER.search(value) or REFERENCE.match(value):
        return False
    words = value.split(" ")
    if len(words) == 1:
        return len(value) >= 8 and bool(re.fullmatch(r"[A-Z]?[a-z]+", value)) and len(set(value)) >= 5 and value.lower() not in _SENTENCE and not _SECRET_TALK.search(value)
    return len(words) >= 4 and len(value) >= 16 and all(re.fullmatch(r"[A-Za-z0-9\-]+", w) and w.lower() not in _SENTENCE for w in words)


def looks_random(v: str) -> bool:
    """Characters as a generator gives them: mixed classes without the build of words."""
    if len(v) < 8 or any(c.isspace() for c in v) or PLACEHOLDER.search(v) or REFERENCE.match(v):
        return False
    classes = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d"))
    turns = sum(_kind(a) != _kind(b) for a, b in zip(v, v[1:], strict=False))
    return classes >= 3 and turns >= max(3, len(v) // 5)


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


# ------------------------------------------------------------------ rules


@dataclass(frozen=True)
class Rule:
    """A regex with the group ``v`` for the value; which trigrams it needs is derived from it.

    ``anchors``: with them the regex is only tried where one of these texts (lower case) begins.
    """

    name: str
    regex: re.Pattern
    anchors: tuple[str, ...] = ()


#: What the names of credentials end with, for the regexes; :func:`is_secret_name` has the last word.
_SHORT = ("pw", "pat", "psw", "mdp", "pem")
_TAIL = (
    "(?i:" + "|".join(sorted({*SECRET_TAILS, "key"} - set(_SHORT), key=len, reverse=True)) + r"|(?:" + "|".join(_SHORT) + r")(?=[\"'`\s=:\],)]))"
)
_ANCHORS = tuple(sorted({*SECRET_TAILS, "key"}))
_LITERAL = r"(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\.){6,})(?P=q)"
_TYPE = r"(?:\s*:\s*[A-Za-z_][\w.]*(?:\[\w+\])?|\s+\*?string|\[\d*\])?"

RULES = (
    Rule(
        "private_key",
        re.compile(r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"),  # :func:`_key_end` finds the other mark
    ),
    Rule(
        "issued_token",
        re.compile(rf"(?<![A-Za-z0-9_\-./+=])(?P<v>(?:{TOKEN_PREFIXES})[A-Za-z0-9_\-.+/=]{{10,}})"),
    ),
    Rule(
        "address_login",
        re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s:/@\"'`<>]*:(?P<v>[^\s/\"'`<>]+)@[\w\[]"),
    ),
    Rule(
        "named_literal",
        re.compile(rf"(?P<n>{_TAIL})(?![A-Za-z])(?:_?(?:value|val|str|string|default|raw|old|new|literal)|\d+)?[\"'`]?\s?\]?{_TYPE}\s*(?::=|=>|->|=|:|,|\s)\s*\(?\s*(?:[\w.$]+\s*(?:\|\||\?\?|or)\s*)?[fbruL@]?" + _LITERAL),
        _ANCHORS,
    ),
    Rule(
        "named_plain",
        re.compile(rf"(?m)(?P<n>{_TAIL})[\"']?[ \t]*(?:=|:)[ \t]*(?P<v>[^\s\"'`#][^\s]*)[ \t]*(?:#.*)?\r?$"),
        _ANCHORS,
    ),
    Rule(
        "command_option",
        re.compile(rf"(?P<n>(?<![\w-])-[pu](?=[=\s])|{_TAIL})(?:=|\s+)(?P<q>[\"']?)(?P<v>[^\s\"'`]{{6,}})(?P=q)"),
        (*_ANCHORS, "-p", "-u"),
    ),
    Rule(
        "login_call",
        re.compile(
            r"(?i)(?:auth|login|log_in|signin|sign_in|authenticate|dial|connect|credentials?|password)\s*\((?:[^()\n]*?,)??\s*[\"'`][^\"'`\n]*[\"'`]\s*,\s*" + _LITERAL + r"\s*[,)]"
        ),
    ),
    Rule(
        "header",
        re.compile(
            r"(?i)\b(?:x-[\w-]*(?:key|token|auth|secret)[\w-]*|authorization|private-token|api-key|cookie)[\"'`]?\]?\s*(?::|=|,)\s*[\"'`]?(?:(?:bearer|basic|token|apikey)\s+)?(?P<v>[^\s\"'`,;]{6,})"
        ),
        ("x-", "authorization", "private-token", "api-key", "cookie"),
    ),
    Rule(
        "scheme_word",
        re.compile(r"(?i:\b(?:Bearer|Basic))\s+(?P<v>[A-Za-z0-9_\-.+/=*!#%$&~^@]{6,})"),
        ("bearer", "basic"),
    ),
    Rule(
        "prose",
        re.compile(
            r"(?i)\b(?P<n>pass(?:word|phrase|wd|code|wort)?|kennwort|pwd|secret|token|key|login|credentials?|pin|contraseña|mot de passe)s?\b[ \t]*"
            r"(?P<link>(?:(?:is|was|now|:|=|->|=>|→|lautet|ist|es|est)[ \t]+)?(?:[\w.\-]{1,20}[ \t]*/[ \t]*)?)[`\"']?(?P<v>[^\s`\"'<>]{6,})[`\"']?"
        ),
        ("pass", "kennwort", "pwd", "secret", "token", "key", "login", "credential", "pin", "contraseña", "mot de passe"),
    ),
    Rule(
        "joined_option",
        re.compile(r"\b(?:mysql(?:dump|admin|import)?|mariadb|sshpass)\b[^\n|;&]{0,200}?\s-p(?P<v>[^\s\"'`=\-][^\s\"'`]{3,})"),
    ),
    Rule(
        "hook_address",
        re.compile(r"https://(?:[\w\-]+\.)*(?:hooks?|webhooks?)[\w\-]*\.[\w.\-]+/(?:[\w\-]+/)+(?P<v>[A-Za-z0-9_\-]{20,})|https://[\w.\-]+/(?:[\w\-]+/)*(?:webhooks?|hooks)/(?:[\w\-]+/)+(?P<w>[A-Za-z0-9_\-]{20,})"),
    ),
    Rule(
        "compared_literal",
        re.compile(r"(?:[=!]==? ?(?=[\"'`])|\.equals\(|strcmp\([^,\n]*, ?|compare_digest\([^,\n]*, ?)" + _LITERAL),
    ),
    Rule(
        "fallback_literal",
        re.compile(r"(?:\bor|\|\||\?\?) (?=[\"'`])" + _LITERAL),
    ),
)
RULE_NAMES = tuple(r.name for r in RULES)

# Extensions of program text, where a value without quotes is an expression.
CODE_FILES = (".go", ".py", ".js", ".java", ".c", ".h", ".ts", ".jsx", ".tsx", ".rs", ".rb", ".php", ".scala", ".cpp", ".cc", ".hpp")
#: How files of pictures, fonts, programs and archives begin, in base64 or hex: embedded data, not a value split over literals.
_DATA = re.compile(r"iVBORw0KGgo|/9j/|R0lGOD|UklGR|d09G[RM]|AAEAAAA|T1RUTw|JVBERi0|UEsDB|H4sIA|QlpoO|f0VMR|TVqQ|AGFzbQ|89504e47|ffd8ff|47494638|504b0304|1f8b08|7f454c46|0061736d", re.I)
_DATA_FILE = re.compile(r"(?i)(?:^|[/_.\-])(?:data|assets?|blobs?|bindata|embed(?:ded)?|icons?|fonts?|images?)(?:[_\-][^/.]*)?\.\w+$")
_KEY_MARK = re.compile(r"-----(?P<kind>BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_JOIN = re.compile(r"\s*\+?\s*(?:\\\s*)?(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\.)+)(?P=q)")
_COMMENT = re.compile(r"(?://|#|/\*|^\s*\*|--|<!--|\"\"\")")
_OPTION_NAMES = frozenset("p password passwd pass pw pwd token secret api-key apikey access-token auth-token secret-key client-secret passphrase private-token auth".split())
_SECRET_TALK = re.compile(r"(?i)pass(?:word|phrase|wd|code)|secret|token|credential|kennwort|api.?key|login")


_PUBLIC_KEY = re.compile(r"(?i)public|pub_?key|primary|foreign|sort|cache|partition|index|map|dict|lookup|row|group")


def _matches(rule: Rule, code: str, low: str):
    """Matches, also such that begin inside the value of an earlier one: what looks like a value can hold the next name."""
    if not rule.anchors:
        at = 0
        while m := rule.regex.search(code, at):
            yield m
            at = max(m.start() + 1, m.start("v"))  # a value can hold the next name
        return
    places = set()
    for a in rule.anchors:
        at = low.find(a)
        while at >= 0:
            places.add(at)
            at = low.find(a, at + 1)
    match = rule.regex.match
    for at in sorted(places):
        if m := match(code, at):
            yield m


_NAME_END = re.compile(r"[\w$\-]*$")
_LINE_START = re.compile(r"[ \t>$#]*(?:-\s+)?(?:export\s+|set\s+|ENV\s+)?[\"']?[\w.\-]*$")


def _whole_name(code: str, m: re.Match) -> str:
    """The identifier or option that ends with the matched tail."""
    return _NAME_END.search(code, max(0, m.start("n") - 80), m.end("n")).group()


def _before(code: str, m: re.Match) -> str:
    return code[code.rfind("\n", 0, m.start("n")) + 1 : m.start("n")]


def _comment_part(code: str, start: int) -> bool:
    """True if the place lies behind a comment mark of its line, or its line is not program text."""
    line = code[code.rfind("\n", 0, start) + 1 : start]
    return bool(_COMMENT.search(line))


def _key_end(code: str, begin: re.Match) -> int | None:
    """The end of the END line that belongs to a BEGIN line, however long the key; None if another key begins first or nothing lies between."""
    m = _KEY_MARK.search(code, begin.end("v"))
    if m and m.group("kind") == "END" and m.start() - begin.end("v") >= 20:
        return m.end()
    return None


def _is_data(code: str, path: str, parts: list[tuple[int, int]]) -> bool:
    """Whether joined literals are an embedded file by their content, whatever their number.

    Either they begin as a known kind of file does, or they are base64 in full rows of an encoder's width and the file's name
    says data or the "name" was the end of the row before; in doubt they are a value.
    """
    values = [code[s:e] for s, e in parts]
    head = code[: parts[0][0] - 1].rstrip(" \t\r\n+\\")
    if head[-1:] in ("'", '"', "`"):
        row = head[head.rfind(head[-1], 0, -1) + 1 : -1]
        if len(row) >= max(60, len(values[0])) and re.fullmatch(r"[A-Za-z0-9+/]+", row):
            return True
    if len(values) < 2:
        return False
    if _DATA.match(values[0]):
        return True
    width, whole = len(values[0]), "".join(values)
    rows = len(values) > 2 and width >= 60 and width % 4 == 0 and all(len(v) == width for v in values[:-1]) and len(values[-1]) <= width
    if not rows or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", whole) or "+" not in whole or "/" not in whole:
        return False
    return bool(_DATA_FILE.search(path))


def find(code: str, path: str, rules: tuple[int, ...] = tuple(range(len(RULES)))) -> list[tuple[int, int, str]]:
    """(start, end, rule) of the credentials in one chunk: spans of values alone, without overlap, in order."""
    taken: list[tuple[int, int, str]] = []
    is_code = path.lower().endswith(CODE_FILES)
    low = code.lower()
    if len(low) != len(code):  # a few letters grow in lower case
        low = "".join([c.lower() if len(c.lower()) == 1 else c for c in code])

    def add(start: int, end: int, rule: str) -> bool:
        if any(s < end and start < e for s, e, _ in taken):
            return False
        taken.append((start, end, rule))
        return True

    def add_literal(m: re.Match, rule: str) -> None:
        """The literal, and those joined to it."""
        parts, at = [m.span("v")], m.end("v") + 1
        while (j := _JOIN.match(code, at)) and re.search(r"[+\n]", code[at : j.start("q")]) and re.fullmatch(r"[\w+/=.\-!#$%^&*@~]+", j.group("v")):
            parts.append(j.span("v"))
            at = j.end()
        if _is_data(code, path, parts):
            return
        for start, end in parts:
            add(start, end, rule)

    for i in rules:
        rule = RULES[i]
        for m in _matches(rule, code, low):
            v = m.group("v")
            name = rule.name
            if name == "private_key":
                if end := _key_end(code, m):
                    add(m.start("v"), end, name)
            elif name == "issued_token":
                v2 = v.rstrip(".-/")
                body = re.sub(rf"^(?:{TOKEN_PREFIXES})", "", v2)
                if v2.startswith("eyJ") and v2.count(".") < 2:
                    continue
                if not PLACEHOLDER.search(v2) and len(set(body)) >= 6 and (any(c.isdigit() for c in body) or re.search(r"[a-z][A-Z]", body)):
                    add(m.start("v"), m.start("v") + len(v2), name)
            elif name == "address_login":
                if v and not PLACEHOLDER.search(v) and not REFERENCE.match(v) and not v.startswith(("$", "%", "{")) and len(set(v)) > 2:
                    add(m.start("v"), m.end("v"), name)
            elif name == "named_literal":
                n = _whole_name(code, m)
                if is_secret_name(n) or (n.lower().endswith("key") and looks_random(v) and not _PUBLIC_KEY.search(n)):
                    s = re.match(r"(?i)(?:authorization:\s*)?(?:bearer|basic|token)\s+", v)
                    if s:
                        if is_live(v[s.end() :]):
                            add(m.start("v") + s.end(), m.end("v"), name)
                    elif is_live(v) and not v.startswith("-----BEGIN"):
                        add_literal(m, name)
                    elif is_made_up(n, v):
                        add(m.start("v"), m.end("v"), name)
            elif name == "named_plain":
                if not is_code and _LINE_START.match(_before(code, m)) and is_secret_name(_whole_name(code, m)) and is_live(v.rstrip(",;")):
                    add(m.start("v"), m.start("v") + len(v.rstrip(",;")), name)
            elif name == "command_option":
                opt = _whole_name(code, m).lower()
                dashes, opt = opt[: len(opt) - len(opt.lstrip("-"))], opt.lstrip("-")
                if not dashes or len(dashes) > 2 or re.search(r"\w$", code[max(0, m.end("n") - len(opt) - len(dashes) - 1) : m.end("n") - len(opt) - len(dashes)]):
                    continue
                if opt == "u" and ":" in v:
                    secret = v.split(":", 1)[1]
                    if is_live(secret):
                        add(m.end("v") - len(secret), m.end("v"), name)
                elif (opt in _OPTION_NAMES or opt != "p" and is_secret_name(opt)) and is_live(v) and (opt != "p" or _login_command(code, m.start())):
                    add(m.start("v"), m.end("v"), name)
            elif name == "login_call":
                if is_live(v):
                    add_literal(m, name)
            elif name in ("header", "scheme_word"):
                v2 = v.rstrip(")].,;}")
                if is_live(v2) and (name == "header" or any(c.isdigit() for c in v2) or looks_random(v2)) and not (is_code and re.fullmatch(r"[A-Za-z_][\w.]*\(?", v2) and not looks_random(v2)):
                    add(m.start("v"), m.start("v") + len(v2), name)
            elif name == "prose":
                linked = m.group("link").strip()
                v2 = v.rstrip(".,;:)]}").rstrip("`\"'")
                if is_live(v2) and (not is_code or _comment_part(code, m.start())) and _prose_value(v2, bool(linked)):
                    add(m.start("v"), m.start("v") + len(v2), name)
            elif name == "joined_option":
                if is_live(v) or (len(v) >= 4 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not PLACEHOLDER.search(v) and not REFERENCE.match(v)):
                    add(m.start("v"), m.end("v"), name)
            elif name == "hook_address":
                group = "v" if v else "w"
                if looks_random(m.group(group)):
                    add(m.start(group), m.end(group), name)
            elif name == "compared_literal":
                rest = (code[code.rfind("\n", 0, m.start()) + 1 :].split("\n", 1)[0]).replace(v, "")
                if is_live(v) and (_SECRET_TALK.search(rest)) and (any(c.isdigit() for c in v) or looks_random(v) or v.count("-") >= 3):
                    add(m.start("v"), m.end("v"), name)
            elif name == "fallback_literal" and is_live(v) and fallback_value(v):
                add(m.start("v"), m.end("v"), name)
    return sorted(taken)


def _login_command(code: str, at: int) -> bool:
    """True if a plain ``-p`` belongs to a command that takes a password with it."""
    line = code[code.rfind("\n", 0, at) + 1 : at]
    return bool(re.search(r"(?i)\bsshpass\b|\blogin\b|\bmysql\w*\b|\bpsql\b|\bmongo\w*\b|\bredis-cli\b|\bftp\b|-u\s+\w+\s*$|--user(?:name)?[= ]\S+\s*$", line))


def _prose_value(v: str, linked: bool) -> bool:
    """What follows a credential's word in prose is the value, not the next word of the sentence."""
    if re.fullmatch(r"[A-Za-z]+(?:['’][a-z]+)?", v):
        return looks_random(v) or (linked and bool(re.search(r"[a-z][A-Z]|[A-Z]{2,}[a-z]", v)) and len(v) >= 8)
    if re.fullmatch(r"[a-z]+(?:[-_][a-z]+)+", v):
        return linked and v.count("-") >= 2
    if re.search(r"[()\[\]{}=<>,;]", v.rstrip("=")) or re.fullmatch(r"[\w./]+/[\w./]*|[\w]+\.\w{1,5}|[\d.,:]+\w{0,2}", v):
        return False
    return any(c.isdigit() for c in v) or looks_random(v) or bool(re.search(r"[!#$%*@&^]", v))


def fallback_value(v: str) -> bool:
    """A literal behind ``or`` and the like that only a credential looks like."""
    if re.fullmatch(r"[A-Za-z]+", v) or re.fullmatch(r"[\d.\-:/]+", v):
        return looks_random(v) and len(v) >= 10
    if re.fullmatch(r"[a-z]+(?:-[a-z]+){3,}", v):
        return True
    if _HEX.match(v) or re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v):
        return True
    return any(c.isdigit() for c in v) and len(v) >= 8 and bool(re.search(r"[A-Za-z]", v))
