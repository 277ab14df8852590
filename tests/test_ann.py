import numpy as np
import pytest

from sextant.operators import ann, fulltext


def clustered(n, dim=64, seed=1, per=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // per + 1, dim))
    return (centres[np.arange(n) // per] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered(900)
    rows = [(i, [float(v) for v in r], "extra") for i, r in enumerate(x)]
    rows += [(2000, None, "x"), (2001, [1.0] * 3, "x"), (2002, [float("nan")] * 64, "x"), (None, rows[0][1], "x")]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")


@pytest.mark.parametrize("kind", ann.KINDS)
def test_stored_index(spark, vectors, tmp_path, kind):
    x, df = vectors
    ann.build(df, str(tmp_path), kind)
    index = ann.Index(spark, str(tmp_path))
    d = ((x[:, None, :] - x[None, ::30, :]) ** 2).sum(2)
    truth = {(30 * j, int(i)) for j in range(d.shape[1]) for i in np.argsort(d[:, j], kind="stable")[:10]}
    queries = df.filter("vec_id % 30 = 0 and vec_id < 900").selectExpr("vec_id as query_id", "embedding as q")
    got = index.search(queries).collect()
    assert len(truth & {(r["query_id"], r["id"]) for r in got}) >= 0.9 * len(truth)
    assert all(r["id"] == r["query_id"] and r["score"] == pytest.approx(0, abs=1e-9) for r in got if r["rank"] == 1)
    assert [r["id"] for r in index.search([float(v) for v in x[7]], 1).collect()] == [7]
    assert index.search([1.0, 2.0]).count() == 0
    if kind == "ivf_flat":
        plan = index.search(queries, width=2)._jdf.queryExecution().toString()
        assert "dynamicpruning" in plan
        assert {(r["query_id"], r["id"]) for r in index.search(queries, width=10_000).collect()} == truth


@pytest.mark.parametrize("kind", ann.KINDS)
def test_empty_index(spark, vectors, tmp_path, kind):
    ann.build(vectors[1].limit(0), str(tmp_path), kind)
    assert ann.Index(spark, str(tmp_path)).search([0.5] * 64).count() == 0
    with pytest.raises(ValueError):
        ann.build(vectors[1], str(tmp_path), "hnsw")


def test_full_text(spark, tmp_path):
    rows = [(1, "The index of the Index", "x"), (2, "a vector index", "x"), (3, None, "x"), (None, "index", "x"), (4, "", "x"), (5, "nothing here", "x")]
    fulltext.build(spark.createDataFrame(rows, "doc_id long, text string, term string"), str(tmp_path), "doc_id", "text")
    got = [r["id"] for r in fulltext.search(spark, str(tmp_path), ["INDEX", "index", "vector"]).collect()]
    assert got == [2, 1]
    assert fulltext.search(spark, str(tmp_path), ["absent"]).count() == 0 and fulltext.search(spark, str(tmp_path), []).count() == 0
    fulltext.build(spark.createDataFrame(rows[:0], "doc_id long, text string, term string"), str(tmp_path), "doc_id", "text")
    assert fulltext.search(spark, str(tmp_path), ["index"]).count() == 0
