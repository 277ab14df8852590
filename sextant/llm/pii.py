"""Personal information in free text by bootstrapped contextual extraction (problem 9).

1. Each text is read once: places where a name, a document's number or a phone number may stand are found by form, with the
   lexical patterns left, right, on both sides and (for numbers) in the last words before them.  Places that prove themselves are seeds: a name before its
   own mail address, a number behind one of a few names of documents or phones, a phone with its country's prefix or area in brackets.
2. Spark holds a graph of patterns and instances (name words, number formats) and scores both sides in turn, a few rounds,
   over the pre-aggregated edges of all documents.
3. Patterns and instances of high confidence are the model.  They alone decide which names and numbers count, also
   such that no seed was like; mail and postal addresses go by form (:func:`by_form_alone`).

The model goes to the tasks by broadcast only if it has at most ``MODEL_LIMIT`` entries; beyond that each document gets its own
entries by a join (:func:`_with_own_model`).

Defined results: a null or empty text has no finding and a null doc_id is left out; repeated rows give the same spans
(:func:`found` returns them once per doc_id); long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import pii_forms as forms
from sextant.session import materialise, spread

#: Rounds of scoring; score from which an instance or pattern belongs to the model; distinct instances that a pattern needs.
ROUNDS, INSTANCE_SCORE, PATTERN_SCORE, SUPPORT = 4, 0.4, 0.6, 3
#: Entries up to which the model is broadcast (some 100 bytes each).
MODEL_LIMIT = 200_000

# Words that introduce a document's number or a phone number.
_ID_WORDS = (
    "ssn", "passport", "national id", "taxid", "tax id", "iban", "nino", "documento", "dni", "nie", "nif", "ausweis", "personalausweis", "steuer-id", "steuernummer", "passeport",
    "pasaporte", "social security", "insurance number", "carte", "id card", "identity", "personnummer", "account number",
)
_PHONE_WORDS = ("tel", "phone", "call", "ring me", "text", "mobile", "rückruf", "telefon", "tél", "appeler", "llamar", "teléfono", "cell", "fax", "duty")


def _labels(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?:\s?(?:no|nr|number|n°|num)\.?)?[\"']?(?:\s+is)?[\s:=#\"'|]*$")


ID_LABELS, PHONE_LABELS = _labels(_ID_WORDS), _labels(_PHONE_WORDS)


def _patterns(kind: str, left: str, right: str, intro: str) -> list[str]:
    """Patterns of a place: both sides, left, right, and for numbers the last word and the last two words before.

    One-sided ones that only say that a line or sentence begins or ends are left out. :func:`graph` builds the same in SQL.
    """
    out = [f"{kind}B {left} _ {right}"]
    if left.rpartition(" ")[2] not in ("^", ".", "!", "?"):
        out.append(f"{kind}L {left}")
    if right.partition(" ")[0] not in ("$", ".", "!", "?"):
        out.append(f"{kind}R {right}")
    if intro:
        out.append(f"{kind}W {intro.rpartition(' ')[2]}")
        if " " in intro:
            out.append(f"{kind}V {intro}")
    return out


def _index_at(ws: list[forms.Word], start: int, end: int) -> tuple[int, int]:
    """First and last token of a span."""
    lo, hi = 0, len(ws)
    while lo < hi:
        mid = (lo + hi) // 2
        if ws[mid].end <= start:
            lo = mid + 1
        else:
            hi = mid
    last = lo
    while last + 1 < len(ws) and ws[last + 1].start < end:
        last += 1
    return lo, last


class Place(NamedTuple):
    """Where a piece may stand. ``kind``: e mail, a address, i and p numbers, n name.

    ``given``: a number's shape, else the given name; ``form``: a name's order of parts and case, or that a number is part of a mail address.
    """

    kind: str
    start: int
    end: int
    given: str = ""
    family: str = ""
    form: str = ""
    left: str = ""
    right: str = ""
    intro: str = ""
    seed: bool = False


def _name_place(m: forms.Mention, ws: list[forms.Word], seed: bool = False) -> Place:
    left, right = forms.context(ws, m.first, m.last)
    return Place("n", ws[m.first].start, ws[m.last].end, m.given, m.family, f"{m.form}|{m.case}", left, right, "", seed)


def places_of(text: str) -> list[Place]:
    """All places of one text that are found by form, each with its context; tokens are cut only around them."""
    out: list[Place] = []
    mails = list(forms.emails(text))
    by_start = {s: local for s, _, local in mails}
    out += [Place("e", s, e) for s, e, _ in mails]
    out += [Place("a", s, e) for s, e, _ in forms.addresses(text)]
    parts = forms.number_windows(text)
    numbers = [("i", s, e, shape) for s, e, shape in forms.id_numbers(text, parts)] + [("p", s, e, shape) for s, e, shape in forms.phones(text, parts)]
    begins = forms.name_places(text)
    names = set(begins)
    if not (begins or numbers):
        return out
    for low, high in forms.windows(text, sorted([*begins, *(n[1] for n in numbers)])):
        ws = forms.words(text, low, high)
        for kind, s, e, shape in numbers:
            if low <= s < high:
                first, last = _index_at(ws, s, e)
                left, right = forms.context(ws, first, last)
                seed = bool((ID_LABELS if kind == "i" else PHONE_LABELS).search(text, max(0, s - 40), s)) or (kind == "p" and text[s] in "+(")
                inside = any(a < e and s < b for a, b, _ in mails)
                out.append(Place(kind, s, e, shape, "", "mail" if inside else "", left, right, forms.introduction(ws, first), seed))
        if names:
            for m in forms.mentions(ws, None):
                if ws[m.first].start not in names:
                    continue
                seed = False
                end = ws[m.last].end
                if m.form != "IF" and end + 2 in by_start and text[end : end + 2] == " <":
                    local = forms.folded(by_start[end + 2])
                    seed = forms.folded(m.family)[:40] in local or forms.folded(m.given) in local
                out.append(_name_place(m, ws, seed))
    return out


def low_names_of(text: str, names, firsts=None) -> list[Place]:
    """Places where a name in lower case may stand: it begins with a word of ``names``."""
    out: list[Place] = []
    begins = forms.low_places(text, names, firsts)
    if begins:
        starts = set(begins)
        for low, high in forms.windows(text, begins):
            ws = forms.words(text, low, high)
            out += [_name_place(m, ws) for m in forms.mentions(ws, names.__contains__) if m.case == "l" and ws[m.first].start in starts]
    return out


_TEXT_FIELDS = ("kind", "given", "family", "form", "left", "right", "intro")
_PLACES = ", ".join([*(f"{f} array<string>" for f in _TEXT_FIELDS), "start array<int>", "end array<int>", "seed array<boolean>"])


def places(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the places of each text, one array for each of their fields. Texts are tokenised here once."""
    kinds = [(f, pa.string()) for f in _TEXT_FIELDS] + [("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_())]
    number = {f: k for k, f in enumerate(Place._fields)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [places_of(t) for t in b["text"].to_pylist()]
            offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
            flat = list(zip(*(p for ps in found for p in ps), strict=True)) or [()] * len(Place._fields)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[number[f]], kind)) for f, kind in kinds]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], *lists], names=["doc_id", "text", *(f for f, _ in kinds)])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, text string, {_PLACES}")


def graph(located: DataFrame) -> DataFrame:
    """(pattern, instance, n, seeds) over all places of all documents. Weak formats are their own kind of instance, marked with ?."""
    rows = located.select(F.explode(F.arrays_zip("kind", "given", "family", "form", "left", "right", "intro", "seed")).alias("x")).select("x.*")
    # neither single initials nor numbers inside of mail addresses teach anything
    rows = rows.filter(F.col("kind").isin("n", "i", "p") & ~F.col("form").startswith("IF|") & (F.col("form") != "mail"))
    kind, intro = F.col("kind"), F.col("intro")
    ends = ["^", "$", ".", "!", "?"]
    pattern = F.array(
        F.concat(kind, F.lit("B "), "left", F.lit(" _ "), "right"),
        F.when(~F.substring_index("left", " ", -1).isin(ends), F.concat(kind, F.lit("L "), "left")),
        F.when(~F.substring_index("right", " ", 1).isin(ends), F.concat(kind, F.lit("R "), "right")),
        F.when(intro != "", F.concat(kind, F.lit("W "), F.substring_index(intro, " ", -1))),
        F.when(F.contains(intro, F.lit(" ")), F.concat(kind, F.lit("V "), intro)),
    )
    weak = F.col("given").isin(sorted(forms.WEAK_FORMATS)) | F.col("given").startswith("~")
    number = F.concat(kind, F.when(weak, F.lit("?")).otherwise(F.lit("")), F.lit(":"), F.col("given"))
    instance = F.when(kind == "n", F.array(F.concat(F.lit("g:"), "given"), F.concat(F.lit("f:"), "family"))).otherwise(F.array(number))
    pairs = rows.select(F.explode(F.array_compact(pattern)).alias("pattern"), instance.alias("instance"), F.col("seed").cast("long").alias("seed"))
    pairs = pairs.select("pattern", F.explode("instance").alias("instance"), "seed")
    return pairs.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"))


def _side() -> Column:
    """The kind of a pattern: its letter (n, i, p) and side (L, R, B, W, V)."""
    return F.substring("pattern", 1, 2)


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, p, support) and (instance, t): scores of patterns and instances after some rounds.

    A pattern's score is the mean score of what stands in it; one with few distinct instances is worth less, unless seeds stand in it.  In patterns of
    numbers each seed counts by itself and weak formats count for nothing else.  An instance's score is the mean score of its patterns on its best side,
    and 1 if a seed is like it; weak formats have none.
    """
    first = edges.groupBy("instance").agg((F.sum("seeds") > 0).cast("double").alias("t0"))
    weak = F.substring("instance", 2, 1) == "?"
    first = materialise(first.select("instance", F.when(weak, 0.0).otherwise(F.col("t0")).alias("t0")), "pii-seeds")
    instances = first.select("instance", F.col("t0").alias("t"))
    number = F.substring("pattern", 1, 1) != "n"
    held = F.when(number, F.col("seeds") + (F.col("n") - F.col("seeds")) * F.col("t")).otherwise(F.col("n") * F.col("t"))
    for k in range(rounds):
        patterns = (
            edges.join(instances, "instance")
            .groupBy("pattern")
            .agg((F.sum(held) / F.sum("n")).alias("mean"), F.greatest(F.count("*"), F.sum(F.when(number, F.col("seeds")).otherwise(0))).alias("support"))
            .select("pattern", (F.col("mean") * F.least(F.lit(1.0), F.col("support") / SUPPORT)).alias("p"), "support")
        )
        if k == rounds - 1:
            break
        by_side = edges.filter(~weak).join(patterns, "pattern").groupBy("instance", _side().alias("side")).agg((F.sum(F.col("n") * F.col("p")) / (F.sum("n") + 0.5)).alias("s"))
        best = by_side.groupBy("instance").agg(F.max("s").alias("s"))
        instances = materialise(first.join(best, "instance", "left").select("instance", F.greatest("t0", F.coalesce("s", F.lit(0.0))).alias("t")), "pii-scores")
    return patterns, instances


def model(edges: DataFrame) -> DataFrame:
    """(key): patterns and instances of high confidence."""
    patterns, instances = score(edges)
    good = patterns.filter((F.col("p") >= PATTERN_SCORE) & (F.col("support") >= SUPPORT)).select(F.col("pattern").alias("key"))
    return good.unionByName(instances.filter(F.col("t") >= INSTANCE_SCORE).select(F.col("instance").alias("key")))


# ------------------------------------------------------------------ extraction


def _family_known(family: str, known) -> bool:
    return "f:" + family in known or ("-" in family and any("f:" + p in known for p in family.split("-")))


def _is_name(m: Place, known) -> bool:
    form, _, case = m.form.partition("|")
    g, f = "g:" + m.given in known, _family_known(m.family, known)
    if form == "IF":
        return f or any(p in known for p in _patterns("n", m.left, m.right, "") if p[1] in "LB")
    if g and f:
        return True
    if not (g or f) and case == "l":
        return False
    hits = [p[1] for p in _patterns("n", m.left, m.right, "") if p in known]
    if case == "l":
        return bool(hits) and (g or len(hits) > 1)
    if form in ("F,G", "F,GI"):
        return (g or f) and bool(hits)
    if g or f:
        return bool(hits) or form in ("GIF", "GIFp", "GFp")
    return "B" in hits or {"L", "R"} <= set(hits)


def _is_number(p: Place, known) -> bool:
    """A strong format that the model knows, or a pattern of the model before or around the number."""
    return f"{p.kind}:{p.given}" in known or any(x in known for x in _patterns(p.kind, p.left, p.right, p.intro) if x[1] in "LBWV")


_TYPES = {"e": "email", "a": "address", "i": "id_number", "p": "phone"}


def decide(found: list[Place], known) -> list[tuple[str, int, int]]:
    """(type, start, end) of the places of one text that count, in order and without overlap. ``known``: the model's keys.

    Mail goes before addresses, these before numbers of documents, phones and names.
    """
    taken: list[tuple[str, int, int]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or b <= s for _, a, b in taken)

    for kind in "eaip":
        for p in found:
            if p.kind == kind and (kind == "e" or free(p.start, p.end)) and (kind in "ea" or _is_number(p, known)):
                taken.append((_TYPES[kind], p.start, p.end))
    at = -1
    for m in sorted((p for p in found if p.kind == "n"), key=lambda p: (p.start, -p.end)):
        if m.start < at:
            continue
        if ("g:" + m.given in known or _family_known(m.family, known) or not m.form.endswith("|l")) and free(m.start, m.end) and _is_name(m, known):
            taken.append(("name", m.start, m.end))
            at = m.end
    return sorted(taken, key=lambda x: x[1])


def spans_of(text: str, known) -> list[tuple[str, int, int]]:
    """(type, start, end) of what one text holds."""
    return decide(places_of(text) + low_names_of(text, _names(known)), known)


def _names(known) -> frozenset[str]:
    return frozenset(k[2:] for k in known if k[:2] in ("g:", "f:"))


def _keys_of(found: list[Place]) -> set[str]:
    """Every key that the model could hold for some places."""
    keys: set[str] = set()
    for p in found:
        if p.kind == "n":
            keys |= {"g:" + p.given, "f:" + p.family, *("f:" + x for x in p.family.split("-")), *_patterns("n", p.left, p.right, "")}
        elif p.kind in "ip":
            keys |= {f"{p.kind}:{p.given}", *_patterns(p.kind, p.left, p.right, p.intro)}
    return keys


class _Every:
    """Holds every word in lower case: the set of names where the model is not at hand."""

    def __contains__(self, word: str) -> bool:
        return True

    def isdisjoint(self, words) -> bool:
        return not words


def _batch_places(b: pa.RecordBatch) -> Iterator[list[Place]]:
    """The places of each row of a batch of :func:`places`."""
    columns = [b[f].flatten().to_pylist() for f in Place._fields]
    at = 0
    for n in b["start"].value_lengths().to_pylist():
        yield [Place(*(c[i] for c in columns)) for i in range(at, at + n)]
        at += n


def _with_own_model(located: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents with a column ``known``: the model's keys that occur in them, by a join on the key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for d, text, found in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), _batch_places(b), strict=True):
                k = sorted(_keys_of(found + low_names_of(text, _Every(), _Every())))
                ids += [d] * len(k)
                out += k
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(out, pa.string())})

    own = located.mapInArrow(scan, "doc_id long, key string").join(keys, "key", "left_semi")
    return located.join(own.groupBy("doc_id").agg(F.collect_set("key").alias("known")), "doc_id", "left")


def find_spans(docs: DataFrame, limit: int = MODEL_LIMIT) -> DataFrame:
    """(doc_id, pii_type, char_start, char_end) in every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    return _apply(rows, _spans_schema, _spans_batch, limit)


_spans_schema = "doc_id long, pii_type string, char_start int, char_end int"


def _spans_batch(b: pa.RecordBatch, spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
    rows = [(d, kind, s, e) for d, found in zip(b["doc_id"].to_pylist(), spans, strict=True) for kind, s, e in found]
    ids, kinds, starts, ends = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "pii_type": pa.array(kinds, pa.string()), "char_start": pa.array(starts, pa.int32()), "char_end": pa.array(ends, pa.int32()),
    })


def _redacted_batch(b: pa.RecordBatch, spans: list[list[tuple[str, int, int]]]) -> pa.RecordBatch:
    texts = []
    for text, found in zip(b["text"].to_pylist(), spans, strict=True):
        parts, at = [], 0
        for kind, s, e in found:
            parts += [text[at:s], f"[{kind.upper()}]"]
            at = e
        texts.append("".join([*parts, text[at:]]))
    return pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "text_redacted": pa.array(texts, pa.string()), "n_found": pa.array([len(f) for f in spans], pa.int32())})


def _apply(rows: DataFrame, schema: str, work, limit: int, learn: bool = True) -> DataFrame:
    """``work`` over all rows; without ``learn`` under an empty model, which shows what goes by form alone."""
    located = materialise(places(spread(rows)), "pii-places")
    keys = materialise(model(materialise(graph(located), "pii-graph")), "pii-model")
    if not learn:
        keys = keys.limit(0)

    if keys.count() <= limit:
        known = frozenset(r[0] for r in keys.collect())
        shared = rows.sparkSession.sparkContext.broadcast((known, _names(known), forms.first_parts(_names(known))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, names, firsts = shared.value
            for b in batches:
                found = zip(b["text"].to_pylist(), _batch_places(b), strict=True)
                yield work(b, [decide(ps + low_names_of(text, names, firsts), known) for text, ps in found])

        return located.mapInArrow(scan, schema)

    def scan_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for text, ps, k in zip(b["text"].to_pylist(), _batch_places(b), b["known"].to_pylist(), strict=True):
                known = frozenset(k or ())
                spans.append(decide(ps + low_names_of(text, _names(known)), known))
            yield work(b, spans)

    return _with_own_model(located, keys).mapInArrow(scan_own, schema)


def found(docs: DataFrame) -> DataFrame:
    """One row per finding and doc_id."""
    return find_spans(docs).distinct()


def by_form_alone(docs: DataFrame) -> DataFrame:
    """As :func:`found` under an empty model: the findings that no learnt pattern or instance decides."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    return _apply(rows, _spans_schema, _spans_batch, MODEL_LIMIT, learn=False).distinct()


def redact(docs: DataFrame, limit: int = MODEL_LIMIT) -> DataFrame:
    """(doc_id, text_redacted, n_found): typed placeholders in place of the values, all else as it was. Null and empty texts are left out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null and text <> ''")
    return _apply(rows, "doc_id long, text_redacted string, n_found int", _redacted_batch, limit)
