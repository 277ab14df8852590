"""Files that the project's people did not write: generated, minified, vendored and data-only (problem 2).

Layout statistics of each file are counted over the bytes of a whole block at once (line lengths, white space, letters and
digits, numeric literals, encoded runs, numbered names), then compared in Spark SQL with thresholds per
language.  They decide what is generated, minified or data; a generator's banner only lowers the threshold for numbered names.

Third-party copies are laid out like any hand-written file, so layout can not tell them.  They go by the folder, or by the comment that the file begins
with: one that speaks of origin or licence and names somebody (a host, a name with a version, a holder) and nobody of the file's own path.

Defined results: null contents have null statistics and are judged by their folder alone; null paths are left
out; a path given twice is judged twice; an empty file is hand-written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import extension
from sextant.operators.incremental import latest_listing
from sextant.session import spread

# ------------------------------------------------------------------ fixed values

#: Names of folders that hold copies of others' code.
VENDOR_FOLDERS = ("vendor", "third_party", "third-party", "thirdparty", "node_modules", "Godeps", "bower_components", "external", "extern", "deps", "_vendor", "site-packages", "jspm_packages", "Pods", "Carthage")
LANGUAGES = {".go": "go", ".py": "python", ".js": "javascript", ".java": "java", ".c": "c"}
#: Lines that begin with a comment mark; banners and owners are looked for in these.
COMMENT_LINE = re.compile(r"^[ \t]*(?:/\*|//|\*|#|<!--|\"\"\"|''')[^\n]*", re.M)
_MARK = r"(?m)^[ \t]*(?:/\*+!?|//+!?|\*+|#+|<!--|\"\"\"|''')[ \t]*(?:! ?)?"
#: A generator's banner begins a comment; text that only talks about banners does not.
BANNER = re.compile(
    _MARK + r"(?:code generated\b|auto-?generated\b|automatically generated|@generated\b|<auto-?generated|machine[- ](?:written|generated)|generated (?:by|from|with|using|on)\b|do not (?:edit|modify)\b|"
    r"this (?:file|code|class|module) (?:was|is|has been) (?:auto(?:matically)?[- ]?|machine[- ])?(?:generated|produced|written|created|built) (?:by|from|mechanically|automatically|with)|"
    r"produced mechanically|this is (?:a |an )?(?:auto-?)?generated (?:file|code))",
    re.I,
)
#: Words by which the comment at the beginning of a file speaks of where the file is from.
PROVENANCE = re.compile(
    r"(?i)\b(?:cop(?:y|ied|ies|yright)|bundled|vendored|imported|taken|adapted|upstream|licen[cs]e[ds]?|permission|permissive|terms|warrant(?:y|ies)|distributed|redistribut\w+|mirror(?:ed)?|fork(?:ed)?|"
    r"backport(?:ed)?|third[- ]party|belongs|part of|preserve|free to)\b|/\*!|^\W*!"
)
#: How such a comment names somebody.
OWNER = re.compile(
    r"https?://(?:www\.)?(?P<host>[\w.\-]+)|(?P<release>[A-Za-z][\w\-]{2,}) v?\d+\.\d+[\w.]*(?!\w)|@license[ ]+(?P<licence>[\w\-]+)"
    r"|(?:copyright|\(c\)|©)[ ]*(?:\(c\)|©)?[ ]*(?:\d{4}(?:-\d{4})?,?[ ]*)?(?:by )?(?:the )?(?:authors of |people of )?(?P<holder>[A-Za-z][\w.\-]+)(?= (?:authors|contributors|project|team|developers|collective)|\s*$|[.,])"
    r"|\b(?:belongs to|(?:part|copy|fork|port|mirror|property|authors) of)[ ]+(?:the )?(?P<whose>[A-Za-z][\w\-]{2,})(?=[ ]+(?:project|library|team|authors|collective|package)\b|[ ]*$|[.,;:)]|[ ]+v?\d)",
    re.I | re.M,
)
#: Owners that say nothing.
NO_OWNER = frozenset(
    "the all authors me us you this that it code company year mit bsd apache gpl lgpl mpl isc license licence version python java node javascript http https tls utf iso rfc go gcc clang file files module package see".split()
)

#: Thresholds per language: (mean line, longest line, white space share below, numeric density, encoded share, numbered share, share of letters and digits).
#: Each lies between the hand-written files of the language and the others, nearer to the latter; generated lines of C and Go hold more words without a number.
THRESHOLDS = {
    "go": (180.0, 1500, 0.05, 0.45, 0.70, 0.23, 0.86),
    "python": (200.0, 1500, 0.05, 0.45, 0.70, 0.30, 0.86),
    "javascript": (160.0, 1000, 0.08, 0.45, 0.70, 0.30, 0.85),
    "java": (200.0, 1500, 0.05, 0.40, 0.65, 0.28, 0.83),
    "c": (200.0, 1500, 0.05, 0.45, 0.70, 0.185, 0.86),
}
#: What a generator's banner multiplies the threshold for numbered names by.
BANNERED = 0.25

# ------------------------------------------------------------------ statistics

_CLASS = np.zeros(256, np.uint8)  # 1 white space, 2 letter or other, 4 digit, 8 part of an encoded run, 16 underscore
for _c in b" \t\n\r\f\v":
    _CLASS[_c] |= 1
for _c in range(256):
    if chr(_c).isalpha() and _c < 128:
        _CLASS[_c] |= 2 | 8
    elif _c >= 128:
        _CLASS[_c] |= 2
for _c in b"0123456789":
    _CLASS[_c] |= 4 | 8
for _c in b"+/=":
    _CLASS[_c] |= 8
_CLASS[ord("_")] |= 16
#: Length from which a run of encoding characters counts.
RUN = 40
STAT_NAMES = ("n_bytes", "n_lines", "max_line", "mean_line", "space_share", "alnum_share", "numeric_density", "encoded_share", "numbered_share")
#: Bytes that are looked at together.
SLICE = 4 << 20


def _per_text(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[starts[1:]] - total[starts[:-1]]


def layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics of each text in ``data``, one row per text in the order of STAT_NAMES."""
    starts = (offsets - offsets[0]).astype(np.int64)
    raw = data[int(offsets[0]) : int(offsets[-1])]
    n, size = len(starts) - 1, len(raw)
    out = np.zeros((n, len(STAT_NAMES)))
    if size == 0:
        return out
    cls = _CLASS[raw]
    lengths = np.diff(starts)
    word = (cls & 22) > 0
    digit = (cls & 4) > 0
    begins = np.zeros(size, np.bool_)
    begins[starts[:-1][lengths > 0]] = True
    before_word = np.concatenate([[False], word[:-1]]) & ~begins
    after_word = np.concatenate([word[1:], [False]])
    ends = np.zeros(size, np.bool_)
    ends[starts[1:][lengths > 0] - 1] = True
    after_word &= ~ends
    dot = raw == 46
    before_dot = np.concatenate([[False], dot[:-1]]) & ~begins
    words = _per_text(word & ~before_word & ~(before_dot & digit), starts)
    numbers = _per_text(digit & ~before_word & ~before_dot, starts)
    # lines
    newline = raw == 10
    line_end = np.flatnonzero(newline | ends)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_len = line_end - line_start + (~newline[line_end])
    line_text = np.searchsorted(starts, line_start, "right") - 1
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, line_text, line_len)
    filled = np.zeros(n, np.int64)
    content = np.concatenate([[0], np.cumsum((cls & 1) == 0)])
    has = (content[line_end + 1] - content[line_start]) > 0
    np.add.at(filled, line_text[has], 1)
    # names that end in a counter: the last digit of letters followed by digits
    last_digit = digit & ~after_word
    run_start = np.flatnonzero(digit & ~np.concatenate([[False], digit[:-1]]))
    counter = np.flatnonzero(last_digit)
    first = run_start[np.searchsorted(run_start, counter, "right") - 1]
    named = (first > 0) & ((cls[np.maximum(first - 1, 0)] & 18) > 0) & ~begins[first]
    # hexadecimal literals and the like begin with a digit
    tail = counter[named]
    at = np.maximum(first[named] - 1, 0)
    word_start = np.flatnonzero(word & ~before_word)
    origin = word_start[np.searchsorted(word_start, at, "right") - 1]
    tail = tail[~digit[origin]]
    lines_hit = np.unique(np.searchsorted(line_end, tail))
    numbered = np.zeros(n, np.int64)
    np.add.at(numbered, line_text[lines_hit], 1)
    # encoded runs
    code = (cls & 8) > 0
    change = np.flatnonzero(np.diff(np.concatenate([[0], code.view(np.int8), [0]])))
    a, b = change[::2], change[1::2]
    long = (b - a) >= RUN
    encoded = np.zeros(n, np.int64)
    np.add.at(encoded, np.searchsorted(starts, a[long], "right") - 1, (b - a)[long])
    lens = np.maximum(lengths, 1)
    out[:, 0] = lengths
    out[:, 1] = filled
    out[:, 2] = longest
    out[:, 3] = lengths / np.maximum(filled, 1)
    out[:, 4] = _per_text((cls & 1) > 0, starts) / lens
    out[:, 5] = _per_text((cls & 6) > 0, starts) / lens
    out[:, 6] = numbers / np.maximum(words, 1)
    out[:, 7] = encoded / lens
    out[:, 8] = numbered / np.maximum(filled, 1)
    return out


_COMMENTED = re.compile(r"\s*(?:(?:/\*.*?\*/|//[^\n]*|#[^\n]*)\s*)+", re.S)


def head_of(text: str) -> str:
    """The comments that a text begins with, lines without their marks."""
    m = _COMMENTED.match(text.removeprefix("\ufeff"))
    return re.sub(r"(?m)^[ \t]*(?:/\*+|//+|\*+(?!/)|#+)?[ \t]*|[ \t]*\*/|\r$", "", m.group()) if m else ""


def _owners(text: str) -> list[str]:
    head = head_of(text)
    if not head or not PROVENANCE.search(text[: len(head) + 4] if text.startswith("/*!") else head):
        return []
    found = []
    for m in OWNER.finditer(head):
        if m.lastgroup == "host":  # an address counts where its line speaks of origin
            line = head[head.rfind("\n", 0, m.start()) + 1 : head.find("\n", m.end()) if "\n" in head[m.end() :] else len(head)]
            if not PROVENANCE.search(line) or re.search(r"(?i)\b(?:see|visit|cf\.?)\s*$", head[: m.start()]):
                continue
        o = re.sub(r"\.(?:example|com|org|io|net|dev|test|invalid)$", "", m.group(m.lastgroup).lower().rstrip("."))
        if len(o) > 2 and o not in NO_OWNER:
            found.append(o)
    return found


def file_stats(files: DataFrame) -> DataFrame:
    """(path, lang, statistics, banner, owners): one row per file of ``files`` (path, content) with a known extension."""
    lang = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        lang = F.when(extension(F.col("path")) == e, name).otherwise(lang)
    rows = files.select("path", lang.alias("lang"), "content").filter("lang is not null")
    schema = "path string, lang string, n_bytes long, n_lines long, max_line long, mean_line double, space_share double, alnum_share double, numeric_density double, encoded_share double, numbered_share double, banner boolean, owners array<string>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * SLICE / max(whole["content"].nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                texts = b["content"].cast(pa.large_string())
                _, offsets, data = texts.fill_null("").buffers()
                filled = texts.fill_null("")
                off = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
                stats = layout(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off)
                null = np.asarray(texts.is_null())
                cols = {"path": b["path"], "lang": b["lang"]}
                for k, name in enumerate(STAT_NAMES):
                    kind = pa.int64() if k < 3 else pa.float64()
                    cols[name] = pa.array(stats[:, k].astype("int64" if k < 3 else "float64"), kind, mask=null)
                plain = [t or "" for t in texts.to_pylist()]
                remarks = ["\n".join(COMMENT_LINE.findall(t)) for t in plain]
                cols["banner"] = pa.array([BANNER.search(t) is not None for t in remarks], pa.bool_())
                cols["owners"] = pa.array([_owners(t) for t in plain], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(cols)

    return spread(rows.filter("path is not null")).mapInArrow(scan, schema)


# ------------------------------------------------------------------ decisions


def _limit(k: int) -> Column:
    pairs = [F.lit(x) for name, t in THRESHOLDS.items() for x in (name, float(t[k]))]
    return F.try_element_at(F.create_map(*pairs), F.col("lang"))


def reasons(stats: DataFrame) -> DataFrame:
    """``stats`` with the columns vendored (and folder, owner: by what), generated, minified, data_only and foreign."""
    folders = F.split("path", "/")
    vendored = F.arrays_overlap(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), F.array(*[F.lit(x) for x in VENDOR_FOLDERS]))
    own = F.transform(folders, lambda x: F.lower(x))
    # who names the project itself does not speak of somebody else
    third = (F.size("owners") > 0) & ~F.exists("owners", lambda o: F.array_contains(own, o))
    data = (F.col("numeric_density") >= _limit(3)) | (F.col("encoded_share") >= _limit(4)) | ((F.col("alnum_share") >= _limit(6)) & (F.col("n_bytes") > 200))
    small = (F.col("space_share") < _limit(2)) & (F.col("n_bytes") > 40)
    minified = (F.col("mean_line") >= _limit(0)) | ((F.col("max_line") >= _limit(1)) & (F.col("space_share") < 0.12)) | small
    generated = (F.col("numbered_share") >= _limit(5) * F.when(F.col("banner"), BANNERED).otherwise(1.0)) & (F.col("n_lines") >= 3)
    no = F.lit(False)
    out = stats.withColumns({
        "folder": F.coalesce(vendored, no), "owner": F.coalesce(third, no), "vendored": F.coalesce(vendored, no) | F.coalesce(third, no), "generated": F.coalesce(generated, no), "data_only": F.coalesce(data, no),
        "minified": F.coalesce(minified & ~data, no),
    })
    return out.withColumn("foreign", F.col("vendored") | F.col("generated") | F.col("data_only") | F.col("minified"))


def foreign_files(files: DataFrame) -> DataFrame:
    """(path) of the files that were not written by hand."""
    return reasons(file_stats(files)).filter("foreign").select("path").distinct()


def hand_written(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The newest listing of each path without the files that were not written by hand."""
    return latest_listing(listing).join(foreign_files(files), "path", "left_anti").select(*listing.columns)
