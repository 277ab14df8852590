import numpy as np

from sextant.llm import similar as K


def clustered(n, dim=96, seed=1, per=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // per + 1, dim))
    return (centres[np.arange(n) // per] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r], "extra") for i, r in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")


def truth(x, k=10, min_sim=0.8):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in near[i] if s[i, j] >= min_sim}


def test_pairs_match_brute_force(spark):
    x = clustered(1500)
    got = {tuple(r) for r in K.similar_pairs(K.usable_vectors(frame(spark, x)), recall=0.998).collect()}
    want = truth(x)
    assert len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_many_leaves_still_find_neighbours(spark, monkeypatch):
    x = clustered(1200, per=12)
    monkeypatch.setattr(K, "fit", lambda sample, n, branch=4, fit=K.fit: fit(sample, 10**7, branch))
    monkeypatch.setattr(K, "MEMBER_BLOCK", 16)
    monkeypatch.setattr(K, "VISITOR_BLOCK", 16)
    got = {tuple(r) for r in K.similar_pairs(K.usable_vectors(frame(spark, x)), recall=0.998).collect()}
    want = truth(x)
    assert len(want & got) >= 0.98 * len(want)


def test_bad_vectors_and_repeated_ids(spark):
    x = clustered(60)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(100, None), (101, [0.0] * 96), (102, [float("nan")] * 96), (103, [1.0] * 48), (104, [float("inf")] + [1.0] * 95), (None, rows[0][1]), (0, rows[0][1]), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert K.settled(K.usable_vectors(df)).select("vec_id").distinct().count() == 60
    got = {tuple(r) for r in K.similar_pairs(K.usable_vectors(df), recall=1.0).collect()}
    assert got == truth(x)


def test_an_id_with_two_vectors_keeps_the_least(spark):
    x = clustered(40)
    df = frame(spark, np.vstack([x, -x[:1]]), [*range(40), 0])
    v = K.settled(K.usable_vectors(df))
    assert v.count() == 40
    assert v.filter("vec_id = 0").first()["v"] == K.usable_vectors(df).filter("vec_id = 0").agg({"v": "min"}).first()[0]


def test_equal_vectors_in_a_hot_group(spark):
    x = np.vstack([np.repeat(clustered(1), 400, axis=0), clustered(200, seed=3)])
    links = K.neighbour_graph(K.usable_vectors(frame(spark, x)), k=10, min_sim=0.8, recall=1.0)
    counts = {r["a"]: r["n"] for r in links.groupBy("a").count().withColumnRenamed("count", "n").collect()}
    assert all(counts[i] == 10 for i in range(400))


def test_empty_and_single(spark):
    df = frame(spark, clustered(1))
    assert K.similar_pairs(K.usable_vectors(df)).count() == 0
    assert K.similar_pairs(K.usable_vectors(df.limit(0))).count() == 0
    assert K.search(K.usable_vectors(df.limit(0)), exact=True).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_leaves_are_popped_best_bin_first():
    x = unit(clustered(800))
    t = K.calibrate(K.fit(x[:640], 10**7, 4), x, 160, 0.95, 10, -1.0, True)
    assert t.n_leaves > 16
    keys = K._all_keys(t, x[:9])
    rows, leaves, reached = t.best_bin_first(x[:9], np.inf)
    for i in range(9):
        popped = leaves[rows == i]
        assert sorted(popped) == list(range(t.n_leaves))  # without a limit every leaf is popped, once
        assert (np.diff(keys[i, popped]) >= -1e-9).all() and popped[0] == t.home(x[i : i + 1])[0]
        assert reached[rows == i][0] == 0 and (np.diff(reached[rows == i]) >= 0).all()
        # a query stops where its own share reaches theta
        r, few, _ = t.best_bin_first(x[i : i + 1], 0.9)
        assert list(few) == list(popped[reached[rows == i] < 0.9])


def test_queries_widen_by_their_own_queue():
    x = unit(clustered(3000, per=10))
    t = K.calibrate(K.fit(x[:2400], 10**6, 4), x, 600, 0.9, 10, -1.0, False)
    rows, _, _ = t.best_bin_first(x, t.theta)
    visits = np.bincount(rows, minlength=len(x))
    assert visits.min() >= 1 and visits.min() < visits.max() < t.n_leaves


def test_calibrated_recall_holds_for_queries_that_the_fit_has_not_seen():
    x = unit(clustered(6000, per=10))
    got = {}
    for recall in (0.8, 0.95):
        t = K.calibrate(K.fit(x[:4000], 10**6, 8), x[:5000], 1000, recall, 10, -1.0, False)
        q = x[5000:]
        a, b = K._true_links(q, np.arange(5000, 6000), x, 10, -1.0)
        rows, leaves, _ = t.best_bin_first(q, t.theta)
        seen = np.zeros((len(q), t.n_leaves), bool)
        seen[rows, leaves] = True
        got[recall] = seen[a, t.home(x)[b]].mean(), len(rows)
    assert got[0.8][0] >= 0.76 and got[0.95][0] >= 0.93 and got[0.8][1] < got[0.95][1]


def test_exact_mode_matches_brute_force(spark, monkeypatch):
    x = clustered(700)
    monkeypatch.setattr(K, "MEMBER_BLOCK", 128)
    monkeypatch.setattr(K, "VISITOR_BLOCK", 256)
    monkeypatch.setattr(K, "CELLS", 5000)
    assert {tuple(r) for r in K.similar_pairs(K.usable_vectors(frame(spark, x)), exact=True).collect()} == truth(x)


def test_copies_are_classes(spark, monkeypatch):
    base = clustered(240)
    x = np.vstack([base, np.repeat(base[:1], 30, axis=0), np.repeat(base[7:9], 3, axis=0)])
    got = K.neighbour_graph(K.usable_vectors(frame(spark, x)), k=10, min_sim=0.8, recall=1.0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        near.setdefault(r["a"], []).append(r["b"])
    copies = [0, *range(240, 270)]
    for a in copies:  # ties go to the smaller id
        assert near[a] == [c for c in copies if c != a][:10]
    sims = np.round((u @ u.T).astype(np.float64), 5)
    for a in (7, 8, 270, 275, 9, 10):
        order = sorted((j for j in range(len(x)) if j != a and sims[a, j] >= 0.8), key=lambda j: (-sims[a, j], j))[:10]
        assert near.get(a, []) == order
    monkeypatch.setattr(K, "ID_LIMIT", 0)
    again = K.neighbour_graph(K.usable_vectors(frame(spark, x)), k=10, min_sim=0.8, recall=1.0).collect()
    assert {(r["a"], r["b"]) for r in again} == {(r["a"], r["b"]) for r in got}


def test_search_recall(spark):
    x = clustered(1500)
    v = K.usable_vectors(frame(spark, x))
    exact = K.search(v, every=50, exact=True)
    assert exact.groupBy("a").count().filter("count = 10").count() == 30
    row = K.loss(K.search(v, every=50), exact).first()
    assert row["n_exact"] == 300 and row["recall"] >= 0.9
