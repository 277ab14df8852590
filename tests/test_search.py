import json

import pytest
from pyspark.sql import functions as F

from sextant.functions import vectors as V
from sextant.operators import search as S
from sextant.operators.knn import knn, knn_batch, pad_query, recommend
from sextant.plans.spec import QuerySpec, VectorSearch

ROWS = [
    ("a", "f1", "x", "code", [0.0, 0.0]), ("b", "f2", "x", "docs", [0.0, 1.0]), ("c", "f3", "y", "code", [1.0, 0.0]),
    ("d", "f4", None, "code", [2.0, 0.0]), ("e", "f5", "z", "docs", None), ("f", "f6", "w", "docs", [1.0]), ("g", "f7", "y", "code", [1.0, 0.0]),
]


@pytest.fixture(scope="module")
def chunks(spark):
    schema = "chunk_id string, file_path string, code string, embedding_type string, vector array<float>"
    return spark.createDataFrame(ROWS, schema).withColumn("language", F.lit("go")).persist()


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_knn_orders_ties_by_id_and_skips_bad_vectors(chunks):
    assert ids(knn(chunks, [0.0, 0.0], 10)) == ["a", "b", "c", "g", "d"]


def test_knn_prefix_is_monotone(chunks):
    whole = ids(knn(chunks, [0.5, 0.2], 5))
    for k in (1, 2, 3):
        assert ids(knn(chunks, [0.5, 0.2], k)) == whole[:k]


def test_limit_of_zero_means_ten(chunks):
    assert len(ids(knn(chunks, [0.0, 0.0], 0))) == 5


def test_prefilter_and_postfilter(chunks):
    where = "embedding_type = 'docs'"
    pre = QuerySpec(where=where, vector_search=VectorSearch([0.0, 0.0], 2), prefilter=True, columns=("chunk_id",))
    post = QuerySpec(where=where, vector_search=VectorSearch([0.0, 0.0], 1), columns=("chunk_id",))
    assert ids(pre.apply(chunks)) == ["b"]
    assert ids(post.apply(chunks)) == []


def test_empty_table(chunks):
    assert ids(knn(chunks.limit(0), [0.0, 0.0], 3)) == []
    assert S.search(chunks.limit(0), {"code": [0.0, 0.0], "docs": [0.0, 0.0]}).count() == 0


def test_batch_and_recommend(chunks):
    got = {(r["query_id"], r["rn"]): r["chunk_id"] for r in knn_batch(chunks, [(1, [0.0, 0.0]), (2, [2.0, 0.0])], 2).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (2, 1): "d", (2, 2): "c"}
    assert ids(recommend(chunks, "c", 2)) == ["g", "a"]
    assert ids(recommend(chunks, "nobody", 2)) == []
    assert ids(recommend(chunks, "e", 2)) == []


def test_metrics(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = df.select(*[V.distance(m, F.col("v"), [1.0, 0.0]).alias(m) for m in ("l2", "cosine", "dot")]).collect()
    assert got[0]["l2"] == 20.0 and got[0]["cosine"] == pytest.approx(0.4) and got[0]["dot"] == -3.0
    assert got[1]["cosine"] is None and got[2]["l2"] is None
    with pytest.raises(ValueError):
        V.distance("other", F.col("v"), [1.0])


def test_long_vectors_use_the_same_sum(spark):
    q = [0.5] * 300
    df = spark.createDataFrame([([1.0] * 300,)], "v array<float>")
    assert df.select(V.l2(F.col("v"), q)).first()[0] == pytest.approx(75.0)


def test_pad_and_check(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    assert df.select(V.pad(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="longer than"):
        df.select(V.checked(F.col("v"), 2)).collect()
    assert pad_query([1.0], 3) == [1.0, 0.0, 0.0]


def test_modes():
    assert S.resolve_mode() == "hybrid" and S.resolve_mode(docs=True) == "docs"
    with pytest.raises(ValueError):
        S.resolve_mode(code=True, docs=True)


def test_hybrid_dedups_by_text_after_the_limit(chunks):
    q = {"code": [0.0, 0.0], "docs": [0.0, 1.0]}
    before = S.hits(chunks, q, "hybrid", 10)
    after = S.search(chunks, q, "hybrid", 10)
    rows = {r["code"]: r["chunk_id"] for r in after.collect()}
    assert before.count() == 5 and rows == {"x": "a", "y": "c", None: "d"}  # a tie keeps the code side
    assert S.search(chunks, q, "code", 2).count() == 2
    env = json.loads(S.to_json(S.envelope("q", "hybrid", before, after)).first()[0])
    assert env["total_results"] == 5 and env["returned"] == 3 and "heading" not in env["results"][0]


def test_zero_limit_is_not_cut(chunks):
    assert S.search(chunks, {"code": [0.0, 0.0], "docs": [0.0, 0.0]}, "hybrid", 0).count() == 3


def test_text_lines_cut_by_characters(spark):
    row = spark.createDataFrame([("a", "p", 1, 2, "go", "ü" * 150, 0.5, "code")], "chunk_id string, file_path string, line_start int, line_end int, language string, code string, score double, embedding_type string")
    line = S.to_text(row).first()[0]
    assert line.endswith("ü" * 100) and "score 0.5000" in line
