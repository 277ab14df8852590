import numpy as np
import pyarrow as pa

from sextant.llm import origin as O

HAND = "package a\n\n// Finds files marked DO NOT EDIT and leaves them out.\nfunc F(x int) int {\n\tif x > 2 {\n\t\treturn 1\n\t}\n\treturn x\n}\n"


def stats(*texts):
    a = pa.array(texts, pa.large_string())
    _, off, data = a.buffers()
    return O.layout(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.frombuffer(off, np.int64)[: len(texts) + 1])


def test_layout_counts():
    rows = stats("ab cd\n\nx1 = 0x1F, 22.5\n", "", "é é", "A" * 50)
    r = dict(zip(O.STAT_NAMES, rows[0], strict=True))
    assert r["n_bytes"] == 23 and r["n_lines"] == 2 and r["max_line"] == 15 and r["numbered_share"] == 0.5
    assert r["numeric_density"] == 2 / 5
    assert rows[1].sum() == 0 and rows[3][7] == 1.0


def test_banners_and_owners():
    assert O.BANNER.search("// Code generated by x. DO NOT EDIT.")
    assert O.BANNER.search(" * @generated by x")
    assert not O.BANNER.search("// Writes the files; its output carries a generated-by banner.")
    assert not O.BANNER.search("# Finds files marked DO NOT EDIT and leaves them out.")
    assert O._owners("/*\n * This is a bundled copy of libx 3.1.0; report bugs upstream.\n */") == ["libx"]
    assert O._owners("// Copyright (c) the my-repo authors. All rights reserved.") == ["my-repo"]
    assert O._owners("// nothing here") == []


def test_owners_by_other_words():
    for head, want in (
        ("/* Adapted from https://libz.example/src under its licence. */", ["libz"]), ("# Vendored from zed-kit 2.4.0, see upstream for the licence.\n", ["zed-kit"]), ("// (c) 2021 Quux contributors\n// Redistribution is allowed.", ["quux"]),
        ("/*\n * Mirror of the zedlib project.\n */", ["zedlib"]), ("// Fork of quuxlib v3; licensed as upstream.", ["quuxlib"]), ("// See https://docs.test/x for the protocol.", []), ("x = 1  # copy of zed 1.2", []),
    ):
        assert O._owners(head + "\nx = 1\n") == want


def test_letters_and_digits_alone(spark):
    blob = "const x = [" + ",".join("abcdef12" for _ in range(80)) + "];"
    files = spark.createDataFrame([("/r/m/a.js", blob)], "path string, content string")
    r = O.reasons(O.file_stats(files)).first()
    assert r["alnum_share"] > 0.85 and r["encoded_share"] == 0 and r["data_only"] and not r["folder"] and not r["owner"]


def test_frame(spark):
    numbers = "var x = []float64{\n" + "1.5, 2.25, 3.125, 4, 5, 6,\n" * 40 + "}\n"
    packed = "!function(e,t){" + "var a=e.b>1?t[0]:e.c;" * 60 + "}()"
    getters = "package a\n" + "".join(f"func (x *A) GetB{i}() int {{\n\treturn x.B{i}\n}}\n" for i in range(9))
    rows = [
        ("/r/mine/a.go", HAND), ("/r/mine/vendor/x/a.go", HAND), ("/r/mine/vendor_list/a.go", HAND), ("/r/mine/n.go", numbers), ("/r/mine/p.js", packed), ("/r/mine/g.go", getters),
        ("/r/mine/t.go", "// Part of theirs.\n\n" + HAND), ("/r/mine/o.go", "// Part of mine.\n\n" + HAND), ("/r/mine/null.go", None), ("/r/mine/vendor/null.go", None), ("/r/mine/e.py", ""),
        ("/r/mine/x.md", numbers), (None, HAND), ("/r/mine/b.c", "/* Code generated by x. DO NOT EDIT. */\nint get_a1(void);\nint get(void);\nint put(void);\nint end(void);\n"),
        ("/r/mine/b2.c", "/* Code generated by x. DO NOT EDIT. */\nint get(void);\nint put(void);\nint end(void);\n"), ("/r/mine/b3.c", "int get_a1(void);\nint get(void);\nint put(void);\nint end(void);\nint run(void);\nint set(void);\n"),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {r["path"].removeprefix("/r/mine/") for r in O.foreign_files(files).collect()}
    assert got == {"vendor/x/a.go", "n.go", "p.js", "g.go", "t.go", "vendor/null.go", "b.c"}
    listing = spark.createDataFrame([("mine", "/r/mine/a.go", "go", None, None), ("mine", "/r/mine/n.go", "go", None, None), ("mine", None, None, None, None)], "repo string, path string, language string, mod_time timestamp, listed_at timestamp")
    assert [r["path"] for r in O.hand_written(listing, files).collect()] == ["/r/mine/a.go"]
    assert O.foreign_files(files.limit(0)).count() == 0
