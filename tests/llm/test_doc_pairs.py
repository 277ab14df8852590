import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import doc_pairs as D
from sextant.llm import lr_tables
from sextant.llm.syntax import Reader

READERS = {}
DOC = "Returns the number of rows that are left after the blank lines."


def links(language, text):
    if language not in READERS:
        READERS[language] = Reader(language, lr_tables.load(language))
    open_ = []
    assert READERS[language].check(text, open_) is None
    return list(D.pairs_of(text, language, open_))


def pairs(language, text):
    return [(f.name, f.line + 1) for f, c in links(language, text) if c.place in ("above", "docstring")]


def placed(language, text):
    return {f.name: (c.place, c.text.split()[0]) for f, c in links(language, text)}


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("go", f"package a\n\n// F {DOC}\n//go:noinline\nfunc F(x int) int {{\n\treturn 1\n}}\n", [("F", 5)]),
        ("go", f"package a\n\n// {DOC}\n\nfunc F(x int) int {{\n\treturn 1\n}}\n", []),
        ("go", f"package a\n\n/* {DOC} */\nfunc (t *T) M(\n\tx int,\n) (\n\tint, error,\n) {{\n\treturn 1, nil\n}}\n", [("M", 4)]),
        ("go", "package a\n\n// x := old(y, 4)\n// if x > 2 { return x }\nfunc F() {\n}\n", []),
        ("go", "package a\n\n// drain the store\nfunc DrainStore() {\n}\n", []),
        ("go", f"package a\n\nvar s = `\n// {DOC}\nfunc F() {{\n`\n", []),
        ("go", f"package a\n\n// {DOC}\nfunc F()\n", []),
        ("python", f'def f(\n    a,\n):\n    """{DOC}"""\n    def g():\n        return 1\n', [("f", 1)]),
        ("python", f'class A:\n    @d\n    async def f(self):  # x\n        r"""{DOC}\n\n        Args:\n            a: b\n        """\n', [("f", 3)]),
        ("python", '"""%s"""\ndef f():\n    """See above."""\n' % DOC, []),
        ("python", 'def f(a, b):\n    """\n    :param a: the first of the two given values\n    """\n', []),
        ("python", f'def f(): "{DOC}"\n', [("f", 1)]),
        ("python", f'def f():\n    x = "{DOC}"\n', []),
        ("javascript", f"/**\n * {DOC}\n * @param x\n */\nconst f = async (x) => {{\n  return x;\n}};\n", [("f", 5)]),
        ("javascript", f"class A {{\n  // {DOC}\n  async m(x) {{\n    if (x) {{ }}\n  }}\n  // {DOC}\n  n = 1;\n}}\n", [("m", 3)]),
        ("javascript", f"// {DOC}\n// eslint-disable-next-line\nfunction f(x)\n{{\n}}\n// {DOC}\nf(1);\n", [("f", 3)]),
        ("java", f"class A {{\n    /**\n     * {DOC}\n     */\n    @Override\n    public List<String> f(int x) throws E {{\n        return g(x);\n    }}\n    // {DOC}\n    int h(int x);\n}}\n", [("f", 6)]),
        ("c", f"/// \\brief {DOC}\nstatic int f(char *p)\n{{\n    return 1;\n}}\n// {DOC}\nint g(void);\n", [("f", 2)]),
        ("c", "/* -------- */\nint f(void) {\n}\n/* TODO: document */\nint g(void) {\n}\n", []),
    ],
)
def test_pairs(language, text, want):
    assert pairs(language, text) == want
    assert pairs(language, text.replace("\n", "\r\n")) == want


def test_words():
    assert D.informative_words("merge the ember", "mergeEmber") == ["the"]
    assert D.informative_words("@param x the first one\n@return all of them here", "f") == []
    assert len(D.informative_words("\\brief Reads the whole file twice", "f")) == 5
    assert D.name_words("parseHTTPHeader_2") >= {"parse", "http", "header", "2"}


def test_assignment_is_least_cost():
    edges = {(0, 0): 1.0, (0, 1): 5.0, (1, 0): 1.5, (1, 1): 9.0, (2, 2): 0.0}
    got = dict(D.assign(edges, 50.0))
    best = min(
        (p for p in itertools.permutations(range(3)) if all((a, b) in edges for a, b in enumerate(p))), key=lambda p: sum(edges[a, b] for a, b in enumerate(p))
    )
    assert got == dict(enumerate(best))
    assert D.assign({}) == [] and len(D.assign({(0, 0): 0.0, (1, 0): 1.0})) == 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.integers(-8, 9).map(lambda x: x / 4), max_size=10))
def test_assignment_against_all_choices(edges):
    def cost(chosen):
        return sum(edges[e] for e in chosen) + D.LIMIT * (4 - len(chosen))

    every = [c for n in range(5) for c in itertools.combinations(edges, n) if len({a for a, _ in c}) == n and len({b for _, b in c}) == n]
    assert cost(D.assign(edges)) == pytest.approx(min(map(cost, every)))


SWAPPED = """package a

// Close releases the pool and all of its connections at once.

// Open makes a pool of connections for the given address.
func Close() {
}

func Open(address string) {
}
"""


def test_the_nearest_comment_may_be_wrong():
    assert placed("go", SWAPPED) == {"Close": ("detached", "Close"), "Open": ("other", "Open")}
    # without a better home for it the nearest comment stays where it is
    alone = SWAPPED.replace("// Close releases the pool and all of its connections at once.\n\n", "").replace("func Open(address string) {\n}\n", "func Open() int\n")
    assert placed("go", alone) == {"Close": ("above", "Open")}


def test_the_assignment_changes_a_link(monkeypatch):
    def nearest(edges, alone=D.LIMIT):  # every function takes its cheapest comment in turn
        taken = {}
        for (a, b), w in sorted(edges.items(), key=lambda e: (e[0][1], e[1])):
            if b not in taken.values() and a not in taken:
                taken[a] = b
        return sorted(taken.items())

    text = SWAPPED.replace("Close releases the pool and all of its connections at once", "All connections go when Close has released the pool")
    best = placed("go", text)
    monkeypatch.setattr(D, "assign", nearest)
    assert best["Open"] == ("other", "Open") and placed("go", text).get("Open") != best["Open"]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("go", f"package a\n\n// F {DOC}\n\nfunc F(x int) {{\n}}\n", {"F": ("detached", "F")}),
        ("go", f"package a\n\n// {DOC}\n\n\n\n\nfunc F(x int) {{\n}}\n", {}),
        ("javascript", f"/**\n * {DOC}\n * @param x what\n * @param y what\n */\n\nfunction f(x, y) {{\n}}\n", {"f": ("detached", DOC.split()[0])}),
        ("javascript", f"/**\n * {DOC}\n * @param a what\n * @param b what\n */\n\nfunction f(x, y) {{\n}}\n", {}),
        ("java", f"class A {{\n    int total(int x) {{\n        // total: {DOC}\n        return x;\n    }}\n}}\n", {"total": ("inside", "total:")}),
        ("python", f"# f: {DOC}\n@d\ndef f(a):\n    return a\n", {"f": ("detached", "f:")}),
        ("python", f"def f(a):\n    # f: {DOC}\n    return a\n", {"f": ("inside", "f:")}),
    ],
)
def test_candidates_from_elsewhere_need_evidence(language, text, want):
    assert placed(language, text) == want


def test_nothing_is_cut():
    body = "".join(f"    x = {i};\n" for i in range(6000))
    text = f"/* {DOC} */\nint f(int x)\n{{\n{body}}}\n"
    (f, c), = links("c", text)
    assert (f.line, f.end) == (1, 6003)
    params = ", ".join(f"int parameter_with_a_long_name_{i}" for i in range(60))
    (f, _), = links("c", f"/* {DOC} */\nint g({params}) {{\n}}\n")
    assert f.signature == f"int g({params}) {{" and len(f.params) == 60
    throws = "".join(f"        E{i},\n" for i in range(30))
    (f, _), = links("java", f"class A {{\n    // {DOC}\n    void h(int x) throws\n{throws}        Z {{\n    }}\n}}\n")
    assert f.name == "h" and f.end == 34


def test_branches_of_the_preprocessor():
    text = f"#ifdef A\n/* {DOC} */\nint f(void) {{ return 1; }}\n#else\n/* {DOC} */\nint g(void) {{ return 2; }}\n#endif\n#if 0\n/* {DOC} */\nint h(void) {{ return it's; }}\n#endif\n"
    assert [n for n, _ in pairs("c", text)] == ["f", "g"]


def test_frame(spark):
    go = f"package a\n\n// {DOC}\nfunc F() {{\n}}\n"
    rows = [("a.go", go, 1), ("a.go", go, 1), ("b.go", go + "}", 1), ("c.go", None, 1), (None, go, 1), ("d.md", go, 1), ("e.go", "package a\n", 1)]
    out = D.documented_functions(spark.createDataFrame(rows, "path string, content string, fn_name int")).collect()
    assert [(r["path"], r["fn_name"], r["line_start"], r["line_end"]) for r in out] == [("a.go", "F", 4, 5)] * 2
    assert out[0]["doc"] == DOC and out[0]["code"] == "func F() {\n}"
