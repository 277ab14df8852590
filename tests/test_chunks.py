import pytest
from pyspark.sql import functions as F

from sextant.functions import lang as L
from sextant.functions import text as X
from sextant.operators import chunk_code, chunk_text


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_blank_lines(spark):
    got = chunk_text.chunk_blank_lines(files(spark, ("p", "a\nb\n\n \t\nc\n\n\nd"), ("q", None), ("r", ""), ("s", "\n\n"))).orderBy("line_start").collect()
    assert [(r["line_start"], r["line_end"], r["code"]) for r in got] == [(1, 2, "a\nb"), (5, 5, "c"), (8, 8, "d")]


def test_whole_file_counts_bytes_in_compat_mode(spark):
    f = files(spark, ("d/n.txt", "ä\nb\n"), ("x", None), ("e", ""))
    got = {r["name"]: r["line_end"] for r in chunk_text.chunk_whole(f).collect()}
    assert got == {"n.txt": 5, "e": 0}
    assert chunk_text.chunk_whole(f, compat=False).filter("name = 'n.txt'").first()["line_end"] == 2


MD = "# A\n## B\n### C\n### D\n## E"


def parents(spark, text, compat=True):
    rows = chunk_text.chunk_markdown(files(spark, ("m.md", text)), compat).orderBy("line_start").collect()
    return [r["parent_heading"] for r in rows]


def test_parents_compat_and_tree(spark):
    assert parents(spark, MD) == ["", "A", "A > B", "A", ""]
    assert parents(spark, MD, compat=False) == ["", "A", "A > B", "A > B", "A"]
    assert parents(spark, "# A\n## B\n## C") == ["", "A", ""]


def test_markdown_edges(spark):
    text = "intro\n\n# T  \r\nbody\n```\n# in a fence\n```\n#x\n####### y\n"
    rows = chunk_text.chunk_markdown(files(spark, ("d/m.md", text))).orderBy("line_start").collect()
    assert [(r["chunk_type"], r["heading"], r["heading_level"], r["line_start"], r["line_end"]) for r in rows] == [
        ("content", "", "", 1, 2), ("section", "T", "1", 3, 5), ("section", "in a fence", "1", 6, 9),
    ]


def test_markdown_without_header_is_a_document(spark):
    row = chunk_text.chunk_markdown(files(spark, ("d/m.md", "a\nb\nc"), ("n.md", None), ("o.md", ""))).collect()
    assert [(r["chunk_type"], r["heading"], r["line_end"]) for r in row] == [("document", "m.md", 3)]


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("a.go", "", "go"), ("A.PY", "", "python"), ("x.jsx", None, "javascript"), ("x.tsx", "", "typescript"), ("x.c", "int main() {}", "c"), ("x.c", "class A {};", "cpp"),
        ("x.h", "struct a { int b; };", "c"), ("x.h", "namespace a {}", "cpp"), ("x.h", "", "cpp"), ("data.txt", "", "unknown"), ("Makefile", "", "unknown"), ("x.hpp", "", "cpp"),
    ],
)
def test_languages(spark, path, content, want):
    row = spark.createDataFrame([(path, content)], "path string, content string")
    assert row.select(L.detect_language(F.col("path"), F.col("content"))).first()[0] == want


def test_scanner_table_and_hidden(spark):
    df = spark.createDataFrame([("a.py",), ("b.java",), (".git/c.go",), ("d/.e.go",), ("_p/__init__.py",)], "p string")
    got = [tuple(r) for r in df.select(L.scanner_language(F.col("p")), L.is_hidden(F.col("p"))).collect()]
    assert got == [("python", False), (None, False), ("go", True), ("go", True), ("python", False)]


def test_text_functions(spark):
    df = spark.createDataFrame([("aé",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(X.code_points(F.col("t")), X.fnv1a32(F.col("t"))).collect()]
    h = 2166136261
    for c in "aé":
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    assert got == [(97 + 233, h), (0, 2166136261), (None, None)]


GO = '''package p

import (
	"fmt"
	s "strings"
)

// first line
// HelloWorld says hello.
func HelloWorld(a, b int) (int, error) {
	x := "}" // {
	return 0, nil
}

type User struct {
	Name, Nick string
	Age int
	Base
}

func (u *User) GetName() string { return u.Name }

type (
	R interface {
		Read(p []byte) int
		Close()
	}
	E interface{}
)

func G[T any](v ...T) {}
'''


def test_go_chunks():
    got = {r["name"]: r for r in chunk_code.extract(GO, "go")}
    assert list(got) == ["HelloWorld", "User", "GetName", "R", "E", "G"]
    h = got["HelloWorld"]
    assert (h["chunk_type"], h["signature"], h["line_start"], h["line_end"]) == ("function", "(a, b int) (int, error)", 10, 13)
    assert h["doc_comment"] == "HelloWorld says hello." and h["metadata"]["imports"] == "fmt, strings" and h["metadata"]["package"] == "p"
    assert got["GetName"]["receiver"] == "*User" and got["GetName"]["signature"] == "() string"
    assert got["User"]["metadata"]["fields"] == "Name, Age" and got["R"]["metadata"]["methods"] == "Read, Close"
    assert got["E"]["chunk_type"] == "interface" and got["R"]["code"] == got["E"]["code"] and got["E"]["code"].startswith("type (")


SAMPLES = {
    "python": ("@d\nclass A:\n    def f(self, x=1) -> int:\n        return 1\n\nasync def g():\n    pass\n", [("class", "A"), ("function", "f"), ("function", "g")]),
    "javascript": ("class A {\n  m(x) {\n    if (x) { return '}'; }\n  }\n}\nfunction f(a) { return a; }\nconst g = (x) => { return x; };\n", [("class", "A"), ("method", "m"), ("function", "f"), ("function", "g")]),
    "java": ("public class A {\n  public A(int x) { }\n  private static int f(List<String> a) throws E {\n    return 1;\n  }\n}\ninterface I { }\n", [("class", "A"), ("function", "A"), ("method", "f"), ("interface", "I")]),
    "rust": ("pub struct S { a: i32 }\nimpl S {\n  pub fn f(&self) -> i32 { 1 }\n}\nenum E { A }\ntrait T { }\n", [("struct", "S"), ("impl", "S"), ("function", "f"), ("enum", "E"), ("interface", "T")]),
    "c": ("struct s {\n  int a;\n};\nstatic int f(char *p) {\n  return '}';\n}\nint g(void);\n", [("struct", "s"), ("function", "f")]),
    "ruby": ("module M\n  class A\n    def f(x)\n      if x\n        1\n      end\n    end\n  end\nend\n", [("module", "M"), ("class", "A"), ("method", "f")]),
    "php": ("<?php\nclass A {\n  public function m($x) { return '}'; }\n}\nfunction f() { }\n", [("class", "A"), ("method", "m"), ("function", "f")]),
    "scala": ("object O {\n  def f(x: Int): Int = {\n    x\n  }\n}\ntrait T { }\n", [("class", "O"), ("function", "f"), ("function", "T")]),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_samples(language):
    text, want = SAMPLES[language]
    got = chunk_code.extract(text, language)
    assert [(r["chunk_type"], r["name"]) for r in got] == want
    assert all(r["metadata"]["language"] == language for r in got)
    assert all(1 <= r["line_start"] <= r["line_end"] <= text.count("\n") + 1 for r in got)


def test_broken_python_falls_back_to_indentation():
    got = chunk_code.extract("def f(:\n    x\n\nclass A:\n    def g(self):\n        y\n", "python")
    assert [r["name"] for r in got] == ["f", "A", "g"]


def test_chunk_code_frame(spark):
    df = spark.createDataFrame([("a.go", "go", GO, 1), ("b", "go", None, 1), ("c", None, "x", 1), ("d", "unknown", "x", 1)], "path string, language string, content string, name int")
    rows = chunk_code.with_ids(chunk_code.chunk_code(df))
    assert rows.count() == 6 and rows.select("chunk_id").distinct().count() == 6


def test_doc_comments_are_what_stands_before():
    from sextant.operators.chunk_code import extract

    py = extract('# first\n# adds\ndef f(a):\n    """Says."""\n    return a\n\n@d\n# inner\ndef g():\n    pass\nclass A:\n    # a method\n    def m(self): pass\n', "python")
    assert [(r["name"], r["doc_comment"], r["metadata"].get("docstring")) for r in py] == [("f", "# adds", "Says."), ("g", "", None), ("A", "", None), ("m", "# a method", None)]
    go = extract("package p\n\n// One line.\n// F is last.\nfunc F() {}\n\n/* Block\n of G */\n\nfunc G() {}\n\nvar x = 1 // no\nfunc H() {}\n", "go")
    assert [(r["name"], r["doc_comment"]) for r in go if r["chunk_type"] == "function"] == [("F", "F is last."), ("G", "Block\n of G"), ("H", "")]
