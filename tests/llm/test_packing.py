import random

import pytest

from sextant.llm import packing as P
from sextant.llm.tokens import encoding, token_counts

TIERS = [("s", 16), ("m", 64), ("l", 256)]


def check(rows, sizes, tiers):
    capacity = dict(tiers)
    boxes, seen = {}, {}
    for r in rows:
        boxes.setdefault((r["profile"], r["container"]), []).append(r)
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
        assert r["capacity"] == capacity[r["profile"]]
    for (profile, _), items in boxes.items():
        spans = sorted((r["offset"], r["offset"] + r["n_tokens"]) for r in items)
        assert spans[0][0] == 0 and spans[-1][1] <= capacity[profile]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert sorted(r["position"] for r in items) == list(range(len(items)))
    largest = max(capacity.values())
    for d, n in sizes.items():
        if n == 0:
            assert d not in seen
        else:
            assert sum(t for _, t in seen[d]) == n and (len(seen[d]) == 1 or n > largest)
    return boxes


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_is_whole_and_tight(spark, seed):
    rng = random.Random(seed)
    sizes = {i: rng.choice([1, 3, 7, 15, 16, 17, 40, 64, 65, 200, 256]) if i % 3 else 5 for i in range(900)}
    sizes[1000], sizes[1001], sizes[1002] = 0, 600, 257
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens int")
    rows = P.pack(df, TIERS, step=4).collect()
    boxes = check(rows, sizes, TIERS)
    used = sum(r["n_tokens"] for r in rows)
    assert used == sum(sizes.values()) and used / sum(dict(TIERS)[p] for p, _ in boxes) > 0.93
    one = P.pack_each(df, TIERS[1:]).collect()
    for t in TIERS[1:]:
        assert sum(r["n_tokens"] for r in one if r["profile"] == t[0]) == used


def test_step_groups_are_balanced(spark):
    df = spark.createDataFrame([(i, 5 + i % 11) for i in range(640)], "doc_id long, n_tokens int")
    rows = P.pack(df, [("s", 16)], step=8).collect()
    cost = {}
    for r in rows:
        cost[r["step_group"]] = cost.get(r["step_group"], 0) + r["n_tokens"] ** 2
    assert max(cost.values()) < 1.3 * min(cost.values())


def test_nulls_empty_and_repeats(spark):
    df = spark.createDataFrame([(None, 5, 1), (1, 5, 1), (1, 5, 1), (2, None, 1), (3, 0, 1)], "doc_id long, n_tokens int, piece int").drop("piece")
    rows = P.pack(df, TIERS).collect()
    assert [r["doc_id"] for r in rows] == [1, 1] and rows[0]["container"] == rows[1]["container"]
    assert P.pack(df.limit(0), TIERS).count() == 0
    u = P.utilisation(P.pack(df, TIERS)).first()
    assert (u["n_items"], u["n_containers"], u["used_tokens"]) == (2, 1, 10)


def test_a_plan_never_overfills():
    rng = random.Random(5)
    for _ in range(200):
        h = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        patterns = P.plan(h, TIERS[:2])
        placed = {}
        for p in patterns:
            assert p.count > 0 and sum(p.sizes) <= p.capacity
            for s in p.sizes:
                placed[s] = placed.get(s, 0) + p.count
        assert placed == h


def test_token_counts(spark):
    from sextant.llm.tokens import DEFAULT

    df = spark.createDataFrame([(1, "hello world", 7), (2, "", 7), (3, None, 7), (4, "x " * 3000, 7)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: len(encoding(DEFAULT).encode_ordinary("x " * 3000))}
