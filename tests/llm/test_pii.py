import pytest

from sextant.llm import pii as P
from sextant.llm import pii_forms as fm


def found(f, text):
    return [text[s:e] for s, e, _ in f(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("My address is a.b@host.test.", ["a.b@host.test"]), ("<elif+x [at] mail [dot] host [dot] test>", ["elif+x [at] mail [dot] host [dot] test"]), ("to g72 at host dot example now", ["g72 at host dot example"]),
        ("n&#64;host.test", ["n&#64;host.test"]), ("user=A@HOST.TEST x", ["A@HOST.TEST"]), ("x(at)host.test", ["x(at)host.test"]), ("noreply@host.test security@host.test ops+unsubscribe@host.test", []),
        ("git@git.host.test:a/b.git", []), ("a@7.4.1 and @a/core@7.4.1", []), ("https://u:p@host.test/x", []), ("meet at noon", []),
    ],
)
def test_mail(text, want):
    assert found(fm.emails, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ring me at +1 415 555 0194 x396 after", ["+1 415 555 0194 x396"]), ("tel 01.99.00.01.60", ["01.99.00.01.60"]), ("(212) 555 0100 |", ["(212) 555 0100"]), ("030/23125-512", ["030/23125-512"]),
        ("+12125550179", ["+12125550179"]), ("617-555-0135 ext. 12.", ["617-555-0135 ext. 12"]), ("001 303 555 0136", ["001 303 555 0136"]), ("020 7946 0191 erbeten", ["020 7946 0191"]),
        ("Build 27872787881 finished at 12:73:73.", []), ("job 2024-996-6423", []), ("Serial 585-585-2841-2841", []), ("10.91.91.91:1278", []), ("0x57117924", []), ("2024-07-26T00:00:32Z", []),
        ("Tel: 0171 1234567", ["0171 1234567"]), ("phone 030 12345678", ["030 12345678"]), ("07700 900123", ["07700 900123"]),
    ],
)
def test_phone(text, want):
    assert found(fm.phones, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("at Flat 4, 41 Emberly Road, Quellburg ZZ4 0QX now", ["Flat 4, 41 Emberly Road, Quellburg ZZ4 0QX"]), ("Tarnweg 3b\n00073 Eastmere Half of", ["Tarnweg 3b\n00073 Eastmere"]),
        ("to 418 Windrush Ave., Apt. 7, Vellmouth last", ["418 Windrush Ave., Apt. 7, Vellmouth"]), ("P.O. Box 201, Lowtarn 00056", ["P.O. Box 201, Lowtarn 00056"]),
        ("29 rue des Maple, 00000 Port Osprey", ["29 rue des Maple, 00000 Port Osprey"]), ("Calle Harrow 47, 2.º B, 00002 Vellmouth", ["Calle Harrow 47, 2.º B, 00002 Vellmouth"]), ("One Ostrel Plaza, Nordhafen", ["One Ostrel Plaza, Nordhafen"]),
        ("Room 14 at the Tarn Street office", []), ("Am Markt 3, 10115 Quellburg", ["Am Markt 3, 10115 Quellburg"]), ("Am 3. Mai", []),
        ("x 1600 Ostrel Avenue NW, Vellmouth, DC 20500 y", ["1600 Ostrel Avenue NW, Vellmouth, DC 20500"]), ("7 Merge " + "step " * 60 + "\n80 Maplecote Court, Brackwater 00049", ["80 Maplecote Court, Brackwater 00049"]), ("Harrowstraße 82, 00012 Saint Corvin", ["Harrowstraße 82, 00012 Saint Corvin"]),
    ],
)
def test_address(text, want):
    assert found(fm.addresses, text) == want


GIVEN = ["Yara", "Emil", "Tuva", "Noor", "Pavel", "Greta", "Samir", "Rosa"]
FAMILY = ["Edemura", "Korstedt", "Linvikson", "Abrnrade", "Velaro", "Tolwick", "Marholt", "Gimoyan"]


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for g in GIVEN:
        for f in FAMILY:
            i += 1
            mail = f"{f.lower()}{i}@host.test"
            rows.append((i, f"Signed-off-by: {g} {f} <{mail}>\nThe Merge step runs last. Der Zerleger bricht ab.\nThanks to {f}, {g} for the patch. Reviewed by {g[0]}. {f}, who asked for more."))
            rows.append((1000 + i, f"Silent Harbor is a code name. Thanks to {g.lower()} {f.lower()} for the patch.\nMy passport is ZZ{5968000 + i}. Build {27872787881 + i} finished.\nSerial 585-585-2841-2841 is printed."))
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (5002, "Thanks to Björn van der Okamura for the patch."), rows[0], (5003, "x " * 20000 + "Thanks to YARA VELARO for the patch.")]
    return spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, pii_type string").persist()


def test_found(docs):
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in P.found(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["pii_type"], text[r["doc_id"]][r["char_start"] : r["char_end"]]))
    assert got[1] == {("name", "Yara Edemura"), ("email", "edemura1@host.test"), ("name", "Edemura, Yara"), ("name", "Y. Edemura")}
    assert got[1001] == {("name", "yara edemura"), ("id_number", "ZZ5968001")}
    assert got[5002] == {("name", "Björn van der Okamura")} and got[5003] == {("name", "YARA VELARO")}
    assert None not in got and 5000 not in got


def test_numbers_count_by_learnt_contexts_only(spark):
    rows = [(i, f"My passport is ZZ{5968000 + i}.\nPermit 4711: {270000000 + i} ok.\nBuild {270000000 + i} finished.") for i in range(20)]
    rows += [(100 + i, f"tax id {370000000 + i} and badge number {x} here") for i, x in enumerate(["ZZ5968100", "903-84-1618", "X1234567L", "840517-123A", "ZZ5968101"])]
    rows += [(200, "The badge number 570000001 is new."), (201, "Tel: 0171 1234567"), (202, "tel: 0172 1234567"), (203, "tel: 0173 1234567 now"), (204, "key 0171 1234567")]
    rows += [(50, "ssn 903-84-1600"), (51, "nie X1234560L"), (52, "personnummer 840517-123B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {(r["doc_id"], text[r["doc_id"]][r["char_start"] : r["char_end"]], r["pii_type"]) for r in P.found(df).collect()}
    assert {x for x in got if x[0] < 50} == {(i, f"ZZ{5968000 + i}", "id_number") for i in range(20)}
    assert {x[1] for x in got if 100 <= x[0] < 200} == {*(f"{370000000 + i}" for i in range(5)), "ZZ5968100", "903-84-1618", "X1234567L", "840517-123A", "ZZ5968101"}
    assert (200, "570000001", "id_number") in got  # behind words that no list holds
    assert {x[0] for x in got if x[0] > 200} == {201, 202, 203}
    assert P.by_form_alone(df).count() == 0


def test_places_are_those_of_the_whole_text():
    text = ("Zeile mit Wort. " * 30 + "Thanks to Yara Edemura, J. R. van der Okamura and EDEMURA, YARA for it; passport ZZ5968001, tel +1 415 555 0194 x396.\n") * 4
    ws = P.forms.words(text)
    want = [(ws[m.first].start, ws[m.last].end, *P.forms.context(ws, m.first, m.last)) for m in P.forms.mentions(ws, None)]
    assert [(p.start, p.end, p.left, p.right) for p in P.places_of(text) if p.kind == "n"] == want
    assert [text[p.start : p.end] for p in P.places_of(text) if p.kind in "ip"] == ["ZZ5968001", "+1 415 555 0194 x396"] * 4


def test_both_ways_to_the_model_agree(docs):
    assert {tuple(r) for r in P.find_spans(docs, limit=0).collect()} == {tuple(r) for r in P.find_spans(docs).collect()}


def test_redact(docs):
    out = {r["doc_id"]: r["text_redacted"] for r in P.redact(docs.filter("doc_id < 2000")).collect()}
    assert out[1].startswith("Signed-off-by: [NAME] <[EMAIL]>\nThe Merge step") and "[ID_NUMBER]. Build" in out[1001]


def test_empty(docs):
    assert P.found(docs.limit(0)).count() == 0
