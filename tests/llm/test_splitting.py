import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.;é{", max_size=900), st.integers(20, 120), st.integers(0, 9))
def test_pieces_rebuild_the_text(text, capacity, overlap):
    pieces = S.cut(text, capacity, overlap)
    assert "".join(text[own:e] for _, own, e in pieces) == text
    for k, (s, own, e) in enumerate(pieces):
        assert e - s <= capacity
        assert own - s == (0 if k == 0 else min(overlap, own))


def test_cuts_at_blank_lines_before_anything_else():
    part = "def f():\n" + "    x = 1\n" * 9
    text = (part + "\n") * 6
    pieces = S.cut(text, 250, 20)
    assert len(pieces) > 1 and all(text[own:].startswith("def") for _, own, _ in pieces)


def test_a_line_too_long_alone_is_cut_behind_words():
    text = "word " * 100
    assert all(text[e - 1] == " " for _, _, e in S.cut(text, 60, 5))
    assert all(e - s <= 60 for s, _, e in S.cut("x" * 500, 60, 5))


def test_frame(spark):
    big = "line of text\n" * 40
    rows = [("a", "p", 5, big, 1), ("a", "p", 5, big, 2), ("b", "p", 1, "x" * 100, 1), ("c", "p", 1, "x" * 101, 1), ("d", None, None, big, 1), ("e", "p", 1, None, 1), ("f", "p", 1, "", 1), (None, "p", 1, big, 1)]
    df = spark.createDataFrame(rows, "chunk_id string, file_path string, line_start int, code string, piece int")
    out = S.split_oversized(df, 100, 10).collect()
    assert {r["id"] for r in out} == {"a", "c", "d"}
    a = sorted((r for r in out if r["id"] == "a"), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in a] == list(range(len(a)))
    lines = big.split("\n")
    for r in a:
        first = big[: r["char_start"]].count("\n")
        assert r["line_start"] == 5 + first and r["piece"] == big[r["char_start"] : r["char_end"]]
        assert r["piece"].split("\n")[0] in lines[first]
        assert r["line_end"] == 5 + big[: r["char_end"] - 1].count("\n")
    with pytest.raises(ValueError):
        S.split_oversized(df, 100, 60)
    assert S.split_oversized(df.limit(0), 100, 10).count() == 0
