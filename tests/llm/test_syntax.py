import ast

import pytest

from sextant.llm import lr_tables, parse_check
from sextant.llm.syntax import Reader

READERS = {}


def fault(language, text):
    if language not in READERS:
        READERS[language] = Reader(language, lr_tables.load(language))
    return READERS[language].check(text)


GOOD = {
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (x int, err error) {\n\tfor i := range a {\n\t\tif v, ok := m[i]; ok && v == (P{1, 2}) {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, *P:\n\t\tgo func() { ch <- 1 }()\n\tdefault:\n\t}\n\tselect {\n\tcase a := <-c:\n\tcase c <- 1:\n\t}\nL:\n\tfor ; ; {\n\t\tbreak L\n\t}\n\tx = []map[string]int{{\"a\": 1}, {}}[0][\"a\"] &^ 3 << 2\n\treturn `raw\n}`, nil\n}\n",
        "package a\nconst (\n\tA = iota\n\tB\n)\nvar f = func(int) error { return nil }\ntype I interface {\n\tM() int\n\t~int | ~string\n}\n",
    ],
    "python": [
        "@d\nasync def f(a, /, b: int = 1, *c, d=2, **e) -> 'x':\n    async with a as b, c:\n        pass\n    return [x async for x in y if x]\n",
        "x = f'{a!r:>{w}} {b[\"c\"]:x} {{}}'\nmatch x:\n    case [1, *r] if r:\n        pass\n    case {'a': b, **c} | C(d, e=f):\n        pass\n    case _:\n        pass\nmatch = 1\nprint(match)\n",
        "try:\n\tx = 1\nexcept* (A, B) as e:\n\tpass\nelse:\n\tpass\nfinally:\n\tpass\nlambda *a, b=1: (yield)\nx: int = y = 2\n".replace("x: int = y = 2", "x: int = 2") + "a, *b = c[1:2, ::3]\nif (n := 1) > 0: pass\n",
        "", "# only a comment\n", "class A(B, metaclass=C):\n  '''doc\n  more'''\n  def f(self): return not self in \\\n     x\n",
    ],
    "javascript": [
        "'use strict'\nconst {a, b: [c = 1], ...d} = require('x')\nlet f = async (x, {y}) => { await g(`t ${x ? `in ${y}` : 'n'} end`) }\nclass A extends B { static #p = 1; get x() { return this?.y ?? 2 } async *[k]() { yield* z } static { } }\nfor (const [k, v] of m) if (k) continue; else break\nreturn a\n++b\nvar r = /[/\"]+/g.test(x) / 2\ndo x++; while (x < 5) y()\nlabel: for (;;) { break label }\nswitch (a) { case 1: default: }\ntry { } catch { } finally { }\nx = { a, 'b': 1, [c]: 2, get d() { return 1 }, ...e, f() {} }\n",
        "#!/usr/bin/env node\n!function(e,t){var n=e.a>1?t[0]:e.b+\"c\";for(var i=0;i<e.length;i++)n(e[i],t)&&e.splice(i--,1);return e}({},0)\n",
    ],
    "java": [
        "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}) public final class C<T extends D & E> extends F<G<H<I>>> implements J, K {\n  private static final Map<String, List<int[]>> M = new HashMap<>();\n  static { int[] a = {1, 2}, b[] = new int[3][]; }\n  C(int... x) throws E { this(); super.f(); }\n  <U> U g(final U u, List<? super U> l) {\n    for (var x : l) if (x instanceof String s && s.length() > 2) continue;\n    Runnable r = () -> { }; BiFunction<A, B, C> q = (a, b) -> a.<X>y(b)[0] >>> 2;\n    int v = switch (k) { case 1, 2 -> 3; default -> { yield 4; } };\n    try (R z = o(); w) { } catch (A | B e) { } finally { }\n    String t = \"\"\"\n      text \"block\"\n      \"\"\";\n    l.stream().map(String::length).filter(x -> x < 1).toArray(int[]::new);\n    return (U) (Object) u;\n  }\n  enum N { A(1) { void f() { } }, B; int x; }\n  record P(int a, int b) { P { } }\n  @interface Q { int v() default 1; }\n}\n"
    ],
    "c": [
        "#include <a.h>\n#define X(a) \\\n  (a)\n#if 0\nnot c at all {{{\n#else\ntypedef struct node { int a : 3; struct node *next; union { int x; }; } node_t;\n#endif\nstatic inline const size_t *f(int (*cb)(void *, int), char argv[], ...) {\n  size_t i, *p = &a[2];\n  for (size_t j = 0; j < sizeof(node_t) && p->x.y; j++, --i) { if (*p == '{') continue; else goto out; }\n  node_t n = { .a = 1, [2] = { 3 } };\n  do x += (int)y * (b) - 1; while (0);\n  switch (x) { case 1 ... 3: default: break; }\nout:\n  return (struct node){ 1 }.next;\n}\nenum e { A, B = 2, };\nextern int g(void), h[];\n"
    ],
}
BAD = {
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\n<<<<<<< HEAD\n", "package a\nfunc f() {\n}\n}\n", "# Notes\n", "package a\nvar x = \"abc\n", "package a\nfunc f() int { return 1 ]\n", "package a\n/* open", "package a\nx := 1\n", ""],
    "python": ["def f(:\n    pass\n", "x = (1,\n", "if x:\npass\n", "x = 'abc\n", "'''open\n", "def f():\n    a\n  b\n", "f() = 1\n", "print 1\n", "a = 08\n", "x = f'{a'\n", "for x in y\n    pass\n", "class A:\n", "x = )\n", "@@ -1 +1 @@\n", "return\x1b[31m\n"],
    "javascript": ["function f( {\n}\n", "var x = {\n", "var s = 'abc\n", "import x from 'y'\n", "let = = 1\n", "if (a { }\n", "<html></html>\n", "}\n", "`open ${x}\n", "var a = /abc\n", "for (;;\n", "x = {a: 1, b: }\n", "class A { f( }\n", "SELECT a FROM b\n", "export default 1\n"],
    "java": ["class A { void f( { } }\n", "class A {\n", "class A { int x = 1 }\n", "class A { void f() { x + 1; } }\n", "class A { String s = \"abc; }\n", "package a\n", "class A { void f() { return 1; ] }\n", "def f(): pass\n", "class A { } }\n"],
    "c": ["int f( {\n}\n", "int f() {\n", "int x = 1\n", "#frob\n", "#if 1\nint a;\n", "char *s = \"abc;\n", "package a\n", "int f() { return 1; }}\n", "key: value\n", "/* open\n", "int a = @;\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in GOOD.items() for t in v])
def test_good(language, text):
    assert fault(language, text) is None
    assert fault(language, text.replace("\n", "\r\n")) is None
    if language == "python":
        ast.parse(text)


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in BAD.items() for t in v])
def test_bad(language, text):
    assert fault(language, text) is not None
    if language == "python":
        with pytest.raises(SyntaxError):
            ast.parse(text)


def test_fault_line():
    f = fault("go", "package a\n\nfunc f() {\n\tx := )\n}\n")
    assert (f.line, f.what) == (4, ")")


def test_memory_gives_the_same_answers():
    text = GOOD["java"][0]
    fresh = Reader("java", lr_tables.load("java"))
    assert fresh.check(text) is None and fresh.check(text) is None
    assert fresh.check(text[:-4]) is not None and fresh.check(text) is None


def test_tables_and_prefer():
    t = lr_tables.build("file: 'a' file | 'a' ;")
    assert set(t.terminals) == {"a", "END"}
    with pytest.raises(ValueError):
        lr_tables.build("file: nothing ;")


def test_frame(spark):
    rows = [("a.go", "package a\n"), ("b.go", "package\n"), ("c.py", ""), ("d.py", None), ("e.md", "# x"), (None, "x"), ("F.JS", "var x = ;"), ("b.go", "package\n"), ("g.c", "int x;\n" * 30000)]
    report = parse_check.syntax_report(spark.createDataFrame(rows, "path string, content string"))
    got = sorted((r["path"], r["valid"]) for r in report.collect())
    assert got == [("F.JS", False), ("a.go", True), ("b.go", False), ("b.go", False), ("c.py", True), ("g.c", True)]
    listing = spark.createDataFrame([("r1", "a.go", "2024-01-01"), ("r2", "a.go", "2024-01-02"), ("r1", None, None)], "repo string, path string, t string").selectExpr("repo", "path", "cast(t as timestamp) as listed_at")
    rates = {(r["repo"], r["lang"]): (r["n_files"], r["n_invalid"]) for r in parse_check.fault_rates(report, listing).collect()}
    assert rates[("r2", "go")] == (1, 0) and rates[(None, "go")] == (2, 2)


@pytest.mark.parametrize(
    ("language", "text", "valid"),
    [
        ("python", "x = rf'\\{x}'\n", True), ("python", "x = f'\\N{DASH}{x}'\n", True), ("python", "x = rf'\\{x'\n", False), ("python", "x = rf'a\\'{y}'\n", True),
        ("javascript", "if (x) /re/.exec(y);\n", True), ("javascript", "o.if(x) / 2 / 1;\n", True), ("javascript", "x = (a) / b / c;\n", True), ("javascript", "const x;\n", False),
        ("javascript", "for (const x of y) {}\n", True), ("javascript", "let {a};\n", False), ("javascript", "const {a} = b, c = 1;\n", True),
        ("java", "open module a.b { requires java.base; requires transitive x.y; exports a.b to c, d.e; uses f.G; provides p.Q with r.S; }\n", True),
        ("java", "class A { void open(int module) { this.exports = module; uses(); } }\n", True), ("java", "modul a.b { requires c; }\n", False),
    ],
)
def test_rare_forms(language, text, valid):
    assert (Reader(language, lr_tables.load(language)).check(text) is None) == valid
