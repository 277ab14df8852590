"""Forms of personal information in free text, and the places where a name may stand.

What is written here are forms (what an address or a number can look like); which numbers and names count is learnt
from the corpus, see :mod:`sextant.llm.pii`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

# ------------------------------------------------------------------ fixed values

ROLE_BOXES = frozenset(
    "noreply no-reply donotreply do-not-reply support security help helpdesk list lists abuse release releases ops info admin administrator postmaster webmaster contact "
    "team dev devs build build-bot bot ci sales billing hello office marketing jobs press newsletter notifications notification owner subscribe unsubscribe mailer-daemon root git "
    "hostmaster hr legal privacy feedback service services users announce maintainers hg svn npm github gitlab jenkins buildbot daemon nobody system alerts alert "
    "monitoring status accounts webadmin it dependabot renovate commits issues reports report docs".split()
)
PARTICLES = ("van der", "van den", "van de", "de la", "de los", "von der", "von", "van", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "al", "bin", "ter", "zu")
STREET_WORDS = (
    r"Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Court|Ct\.?|Drive|Dr\.?|Plaza|Place|Pl\.?|Way|Blvd\.?|Boulevard|Terrace|Square|Sq\.?|Close|Crescent|Row|Walk|"
    r"Parkway|Pkwy\.?|Highway|Hwy\.?|Gardens|Grove|Mews|Hill|Park|View|Circle|Cir\.?"
)
CITY_FIRST = r"(?:Saint|Sankt|St\.?|Grand|Port|New|Old|Fort|Mount|San|Santa|Los|Las|El|La|Le|Bad|North|South|East|West|Upper|Lower|Lake|Great|Little|Big|Nueva|Villa|Cape)"
NUMBER_WORDS = r"(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)"

# ------------------------------------------------------------------ mail

_AT = r"(?:@|＠|&#64;|&#x40;|&commat;|%40|=40|\\u0040|\s?[\[({<]\s?(?:at|AT|At)\s?[\])}>]\s?|\s?[\[({]@[\])}]\s?)"
_DOT = r"(?:\.|&#46;|%2E|\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|point|punto)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_LOCAL = r"[^\W_](?:[\w.+\-%]*[\w+\-])?"
_LOCAL_DOTS = rf"[^\W_][\w+\-]*(?:(?:\.|\s?[\[({{]\s?(?:dot|DOT)\s?[\])}}]\s?|\s(?:dot|DOT)\s)[\w+\-]+)*"
EMAIL = re.compile(
    rf"(?<![\w.+\-%/@])(?:(?P<l1>{_LOCAL}){_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}"
    rf"|(?P<l2>{_LOCAL}) (?:at|AT) {_LABEL}(?:(?:\s(?:dot|DOT)\s|\s?[\[({{](?:dot|DOT)[\])}}]\s?){_LABEL})+)(?![\w@])"
)


#: What every address holds between its parts: only around these the form is tried. A plain "at" needs a written-out dot.
_MARK = re.compile(r"[@＠&%=\\\[({<](?:(?<=[@＠])|(?<=&)(?:#64;|#x40;|commat;)|(?<=[%=])40|(?<=\\)u0040|(?<=[\[({<])\s?(?:at|AT|At)\s?[\])}>])")
_PLAIN_MARK = re.compile(r" (?:at|AT) (?=[^\W_])")


def _marks(text: str) -> list[int]:
    out = [m.start() for m in _MARK.finditer(text)]
    if "dot" in text or "DOT" in text:
        out = sorted([*out, *(m.start() for m in _PLAIN_MARK.finditer(text))])
    return out


def emails(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, local part) of mail addresses of persons."""
    done = 0
    for at in _marks(text):
        if at < done:
            continue
        # the local part is the run before the mark, maybe behind a bracket and a blank
        end = at
        if end > 0 and text[end] == "@" and text[end - 1] in "[({":
            end -= 1
        if end > 0 and text[end] not in "&%=\\" and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_.+-%"):
            start -= 1
        m = EMAIL.match(text, start) if start < end else None
        if not m or m.end() <= at:
            continue
        done = m.end()
        local = (m.group("l1") or m.group("l2")).lower()
        base = local.split("+")[0]
        if base in ROLE_BOXES or "unsubscribe" in local or re.sub(r"\d+$", "", base) in ROLE_BOXES:
            continue
        before = text[max(0, m.start() - 80) : m.start()]
        if re.search(r"://\S*$", before) or re.match(r":[\w~/]", text[m.end() : m.end() + 2]):
            continue
        yield m.start(), m.end(), local


# ------------------------------------------------------------------ numbers

_EXT = r"(?:,?\s?(?:x|ext\.?|Ext\.?|extension|Durchwahl|DW|poste|#)\s?\d{1,6})?"
PHONE = re.compile(
    r"(?<![\w.+#/:@\-])(?:"
    r"\+\d{1,3}[ .\-]?\(\d{1,4}\)[ .\-]?\d{2,4}(?:[ .\-/]?\d{2,5}){1,4}"
    r"|\+\d{1,3}(?:[ .\-/]\d{1,5}){2,6}"
    r"|\+\d{8,15}"
    r"|00\d{1,3}(?:[ .\-/]\d{1,5}){2,6}"
    r"|\(0?\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,5}"
    r"|1[ .\-]\d{3}[ .\-]\d{3}[ .\-]\d{4}"
    r"|\d{3}[.\- ]\d{3}[.\- ]\d{4}"
    r"|0\d{1,4}/\d{3,8}(?:[\- ]\d{1,5})?"
    r"|0\d{2,4} \d{3,4} \d{3,4}"
    r"|0\d(?:[. ]\d{2}){4}"
    r"|(?P<wide>0\d{1,4}[ \-]\d{6,8})"
    rf"){_EXT}(?![\w@]|[.\-/:]\d)"
)


#: Digits close together, as every number here has them: only around such places numbers are looked for.
_DIGITS = re.compile(r"\d(?:[^\d\n]{0,3}\d){5,}")
_CARD = re.compile(r"<\d")
#: Characters around the digits that can belong to a number.
ASIDE = 24


def number_windows(text: str) -> list[tuple[int, int]]:
    """Parts of a text in which a number may stand."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    if "<" in text:
        runs = sorted([*runs, *(m.span() for m in _CARD.finditer(text))])
    out: list[tuple[int, int]] = []
    for start, end in runs:
        low, high = max(0, start - ASIDE), min(len(text), end + ASIDE)
        while high < len(text) and text[high].isalnum():
            high += 1
        if out and low <= out[-1][1]:
            low, high = out[-1][0], max(high, out[-1][1])
            out.pop()
        out.append((low, high))
    return out


def _in_windows(text: str, pattern: re.Pattern, parts: list[tuple[int, int]] | None = None) -> Iterator[re.Match]:
    for low, high in number_windows(text) if parts is None else parts:
        yield from pattern.finditer(text, low, high)


def phones(text: str, parts: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, shape) of what is laid out as a phone number."""
    for m in _in_windows(text, PHONE, parts):
        digits = sum(c.isdigit() for c in re.split(r"[xX#]|[eE]xt", m.group())[0])
        if 8 <= digits <= 15:
            yield m.start(), m.end(), ("~" if m.lastgroup == "wide" else "") + re.sub(r"\d", "0", m.group())


ID = re.compile(
    r"(?<![\w.+#/:@\-])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z]{2}\d{13,30})"
    r"|(?P<paired>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<social>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})"
    r"|(?P<foreign>[XYZ]-?\d{7,8}-?[A-Z])"
    r"|(?P<passport>[A-Z]{1,2}\d{7,8})"
    r"|(?P<national>\d{8}-?[A-Z])"
    r"|(?P<birth>\d{6}[\-+A]\d{3}[0-9A-Z])"
    r"|(?P<card>[A-Z][A-Z0-9]{8}<\d)"
    r"|(?P<bank>\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4})"
    r"|(?P<tax>\d{2}-\d{7}|\d{2} \d{3} \d{3} \d{3}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}/\d{3}/\d{5})"
    r"|(?P<register>[12] \d{2} \d{2} \d{2} \d{3} \d{3}(?: \d{2})?)"
    r"|(?P<plain>\d{9,12})"
    r")(?![\w@<]|[\-/]\w|\.\d)"
)
#: Formats that other numbers share: they count only where a learnt context says so.
WEAK_FORMATS = frozenset(["plain", "tax", "bank", "register"])


def is_weak(shape: str) -> bool:
    """True for formats and phone shapes (marked with ~) that other numbers share."""
    return shape in WEAK_FORMATS or shape.startswith("~")


def id_numbers(text: str, parts: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, format) of what is laid out as the number of a document."""
    for m in _in_windows(text, ID, parts):
        yield m.start(), m.end(), m.lastgroup


# ------------------------------------------------------------------ postal addresses

_CITY = rf"(?:{CITY_FIRST} )?[A-ZÀ-ÖØ-Þ][\w'’\-]*[a-zà-ÿ]"
_UK = r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
_SEP = r"(?:,[ \t]*\n?[ \t]*|[ \t]*\n[ \t]*)"
_UNIT = r"(?:,? (?:Apt\.?|Apartment|Suite|Ste\.?|Unit|Flat|Room|Floor|No\.|#) ?\w+)"
_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
_TAIL_EN = rf"(?:{_SEP}{_CITY},? (?:[A-Z]{{2}} )?(?:\d{{5}}|{_UK})|, ?{_CITY}(?![\w'’]))?"
_TAIL_ZIP = rf"(?:{_SEP}\d{{4,5}} {_CITY}|, ?{_CITY}(?![\w'’]))?"
_RUE = r"(?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|cours)"
_GERMAN = r"(?:Am|Im|Zum|Zur|An de[rnm]|Auf de[rm]|In de[rnm]|Unter den|Hinter de[rmn])"
ADDRESS = re.compile(
    r"(?<![\w/])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \w+,? )?(?:\d{{1,5}}[a-zA-Z]?|{NUMBER_WORDS}),? (?:{_NAME} ){{1,3}}?(?:{STREET_WORDS})(?!\w)(?: (?:NW|NE|SW|SE)(?!\w))?{_UNIT}?{_TAIL_EN}"
    rf"|{_NAME}(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ring|ufer) \d{{1,4}} ?[a-z]?(?!\w){_TAIL_ZIP}"
    rf"|{_GERMAN} {_NAME} \d{{1,4}} ?[a-z]?(?!\w){_SEP}\d{{4,5}} {_CITY}"
    rf"|\d{{1,4}}(?: bis| ter)?,? {_RUE}(?: (?:de la|de l['’]|des|de|du|d['’]))? ?{_NAME}(?: {_NAME})?{_TAIL_ZIP}"
    rf"|(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Via) (?:(?:de la|de los|del|de) )?{_NAME},? \d{{1,4}}(?:, ?\d{{1,2}}\.?[ºª°](?: ?[A-Z](?!\w))?)?{_TAIL_ZIP}"
    rf"|(?:P\. ?O\. ?Box|PO Box|P\.O\.B\.|Postfach|Apartado(?: de correos)?|BP|Boîte postale) \d{{1,6}}(?:{_TAIL_EN}|{_TAIL_ZIP})"
    r")"
)


#: What each of the forms holds: a number before a name, a number behind a street, or one of the words that go before.
_NUMBER_FIRST = re.compile(rf"\d[a-zA-Z]?,? (?:[A-ZÀ-ÖØ-Þ]|bis |ter |(?:bis |ter )?{_RUE}(?!\w))")
_UNIT_FIRST = re.compile(r"(?:Flat|Apt\.?|Apartment|Unit|Suite) \w+,? \Z")
_NUMBER_LAST = re.compile(r" \d")
_STREET_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ring", "ufer")
# one branch for each first letter, so that the search goes from capital to capital
_WORD_FIRST = re.compile(
    r"(?:C(?:alle|/|amino)|A(?:venida|vda\.?|partado|m|n de[rnm]|uf de[rm])|P(?:laza|aseo|\. ?O\.|O|\.O\.B\.|ostfach)|Via|B(?:P|oîte)|I(?:m|n de[rnm])|Z(?:um|ur)|Unter den|Hinter de[rmn]|"
    r"(?:One|T(?:wo|hree|en)|F(?:our|ive)|S(?:ix|even)|Eight|Nine),?) "
)


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, "address") of postal addresses; the form is tried only around its marks."""
    starts = {m.start() for m in _WORD_FIRST.finditer(text)}
    for m in _NUMBER_FIRST.finditer(text):
        at = m.start()
        while at > 0 and text[at - 1].isdigit():
            at -= 1
        starts.add(at)
        if before := _UNIT_FIRST.search(text, max(0, at - 40), at):
            starts.add(before.start())
    for m in _NUMBER_LAST.finditer(text):
        if text.endswith(_STREET_ENDS, 0, m.start()):
            at = m.start()
            while at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_'’-."):
                at -= 1
            starts.update(k for k in range(at, m.start()) if text[k].isupper())
    done = 0
    for at in sorted(starts):
        if at >= done and (m := ADDRESS.match(text, at)):
            yield at, m.end(), "address"
            done = m.end()


# ------------------------------------------------------------------ names

_WORD = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
TOKEN = re.compile(rf"({_WORD})(\.?)|(\d+)|(\n)|([^ \t\r])")


class Word(NamedTuple):
    text: str
    start: int
    end: int
    kind: str  # word, initial, num, nl, punct
    gap: bool  # white space before


def words(text: str, begin: int = 0, stop: int | None = None) -> list[Word]:
    """Tokens of a part of a text; single capital letters with a dot are initials."""
    out, last = [], begin
    push = out.append
    for m in TOKEN.finditer(text, begin, len(text) if stop is None else stop):
        start, end = m.span()
        g = m.lastindex
        gap = start != last
        last = end
        if g == 2:  # a word, maybe with a dot
            w, dot = m.group(1, 2)
            if not dot:
                push(Word(w, start, end, "word", gap))
            elif len(w) == 1 and w.isupper():
                push(Word(w + ".", start, end, "initial", gap))
            else:
                push(Word(w, start, end - 1, "word", gap))
                push(Word(".", end - 1, end, "punct", False))
        else:
            push(Word(m.group(), start, end, _KINDS[g], gap))
    return out


_KINDS = {3: "num", 4: "nl", 5: "punct"}


def _case(w: str) -> str:
    return "U" if w.isupper() and len(w) > 1 else "C" if w[0].isupper() else "l"


@dataclass(slots=True)
class Mention:
    """A place where a name may stand. ``given``: lower case or empty (an initial); ``form``: how the parts are ordered."""

    first: int  # index of the first token
    last: int
    given: str
    family: str
    form: str
    case: str


_PARTICLE_SEQS = sorted({tuple(p.split()) for p in PARTICLES}, key=len, reverse=True)


_PARTICLE_FIRST = frozenset(x[0] for x in _PARTICLE_SEQS) | frozenset(x[0].capitalize() for x in _PARTICLE_SEQS) | frozenset(x[0].upper() for x in _PARTICLE_SEQS)


def _particle(ws: list[Word], i: int) -> int:
    """Number of tokens of the particle at i."""
    if i >= len(ws) or ws[i].text not in _PARTICLE_FIRST:
        return 0
    for seq in _PARTICLE_SEQS:
        if i + len(seq) < len(ws) and all(ws[i + k].kind == "word" and ws[i + k].text.lower() == p and ws[i + k].gap for k, p in enumerate(seq)):
            return len(seq)
    return 0


def mentions(ws: list[Word], lower: Callable[[str], bool] | None) -> Iterator[Mention]:
    """All places of the forms given-family, given-initial-family, initial-family, given-particle-family and family-comma-given.

    ``lower``: says of a word in lower case whether a name may begin with it; without it only capital letters begin names.
    """
    n = len(ws)
    for i, w in enumerate(ws):
        if w.kind == "initial":
            j = i + 1
            while j < n and ws[j].kind == "initial":
                j += 1
            p = _particle(ws, j)
            if j + p < n and ws[j + p].kind == "word" and ws[j + p].gap and _case(ws[j + p].text) in "CU" and len(ws[j + p].text) > 2 and j - i <= 3:
                yield Mention(i, j + p, "", ws[j + p].text.lower(), "IF", "C")
            continue
        if w.kind != "word" or len(w.text) < 2:
            continue
        c = _case(w.text)
        if c == "l" and (lower is None or not lower(w.text)):
            continue
        if i + 1 < n and ws[i + 1].text == "," and i + 2 < n and ws[i + 2].kind == "word" and ws[i + 2].gap and _case(ws[i + 2].text) == c and len(ws[i + 2].text) > 1:
            last = i + 2
            if last + 1 < n and ws[last + 1].kind == "initial":
                yield Mention(i, last + 1, ws[i + 2].text.lower(), w.text.lower(), "F,GI", c)
            yield Mention(i, last, ws[i + 2].text.lower(), w.text.lower(), "F,G", c)
        j, form = i + 1, "GF"
        while j < n and ws[j].kind == "initial" and ws[j].gap and j - i <= 2:
            j, form = j + 1, "GIF"
        p = _particle(ws, j)
        if p:
            k = j + p
            if k < n and ws[k].kind == "word" and ws[k].gap and _case(ws[k].text) == c and len(ws[k].text) > 1:
                yield Mention(i, k, w.text.lower(), ws[k].text.lower(), form + "p", c)
        if j < n and ws[j].kind == "word" and ws[j].gap and len(ws[j].text) > 1 and _case(ws[j].text) == c:
            yield Mention(i, j, w.text.lower(), ws[j].text.lower(), form, c)


#: Characters on each side of a place in which its context is looked for.
BEFORE, BEHIND = 48, 88
_UPPER = "[" + "".join(chr(c) for c in range(0x10000) if chr(c).isupper()) + "]"
_PARTICLE_WORDS = "|".join(sorted({re.escape(p.split()[0]) for p in PARTICLES}, key=len, reverse=True))
#: Where a name in capital letters may begin: a word or an initial before another one.
_BEGIN = re.compile(
    rf"{_UPPER}(?<![^\W\d_].)(?:[^\W\d_]+(?:['’\-][^\W\d_]+)*(?=,?[ \t\r]+(?:{_UPPER}|(?i:{_PARTICLE_WORDS})(?![^\W\d_])))|\.(?=[ \t\r]*(?:{_UPPER}|(?i:{_PARTICLE_WORDS})[ \t\r])))"
)
_ANY_WORD = re.compile(_WORD)


def name_places(text: str) -> list[int]:
    """Where a name in capital letters may begin: a word and the next one are both in capitals or both only begin with one."""
    out = []
    for m in _BEGIN.finditer(text):
        w, at = m.group(), m.end()
        if len(w) > 1 and w[1] != ".":
            while text[at] in ", \t\r":
                at += 1
            after = text[at : at + 2]
            if after[0].isupper() and after[1:] != ".":
                if w.isupper():
                    if not after.isupper():
                        continue
                elif after.isupper() and len(after) > 1 and _ANY_WORD.match(text, at).group().isupper():
                    continue
        out.append(m.start())
    return out


_TO_WORDS = {c: " " for c in range(128) if not chr(c).isalpha()}


def first_parts(names) -> frozenset[str]:
    """``names`` and what their compounds begin with: what :func:`low_places` looks for first."""
    return frozenset(names) | frozenset(re.split(r"['’\-]", n)[0] for n in names)


def low_places(text: str, names, firsts=None) -> list[int]:
    """Where a word in lower case stands that is one of ``names``; ``firsts``: their :func:`first_parts`."""
    if text.isascii():
        if (first_parts(names) if firsts is None else firsts).isdisjoint(text.translate(_TO_WORDS).split()):
            return []
    elif names.isdisjoint(_ANY_WORD.findall(text)):
        return []
    return [m.start() for m in _ANY_WORD.finditer(text) if m.group() in names]


def windows(text: str, places: list[int]) -> Iterator[tuple[int, int]]:
    """Parts of lines, cut at white space, that hold the places with what stands around them."""
    begin = stop = -1
    for at in places:  # in order
        if at + BEHIND / 2 < stop:  # far enough inside the part before
            continue
        low = text.rfind("\n", max(0, at - BEFORE), at) + 1
        if low == 0 and at > BEFORE:
            low = text.find(" ", at - BEFORE, at) + 1 or text.rfind("\n", 0, at) + 1
        high = text.find("\n", at, at + BEHIND)
        if high < 0:
            high = len(text)
            if at + BEHIND < high:
                high = text.find(" ", at + BEHIND)
                line = text.find("\n", at + BEHIND)
                high = min(x for x in (high, line, len(text)) if x >= 0)
        if low <= stop:
            stop = max(stop, high)
            continue
        if stop >= 0:
            yield begin, stop
        begin, stop = low, high
    if stop >= 0:
        yield begin, stop


def context(ws: list[Word], first: int, last: int) -> tuple[str, str]:
    """Lexical contexts to the left and right: two tokens each, not beyond the line; '^' and '$' stand for its ends."""
    left: list[str] = []
    i = first - 1
    while i >= 0 and len(left) < 2:
        if ws[i].kind == "nl":
            break
        left.append("#" if ws[i].kind == "num" else ws[i].text.lower())
        if ws[i].text in ".!?" and ws[i].kind == "punct":
            break
        i -= 1
    if len(left) < 2:
        left.append("^")
    right: list[str] = []
    i = last + 1
    while i < len(ws) and len(right) < 2:
        if ws[i].kind == "nl":
            break
        right.append("#" if ws[i].kind == "num" else ws[i].text.lower())
        i += 1
    if len(right) < 2:
        right.append("$")
    return " ".join(reversed(left)), " ".join(right)


def introduction(ws: list[Word], first: int) -> str:
    """The last two words before a place within its line, whatever marks stand between; one or none if there are no more."""
    out: list[str] = []
    i = first - 1
    while i >= 0 and len(out) < 2 and first - i <= 8 and ws[i].kind not in ("nl", "num"):
        if ws[i].kind in ("word", "initial"):
            out.append(ws[i].text.lower())
        i -= 1
    return " ".join(reversed(out))


def folded(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("ø", "o").replace("ß", "ss")) if not unicodedata.combining(c))
