import pytest
from pyspark.sql import functions as F

from sextant.llm import mixing as M


def test_schedule_stays_within_one_block():
    w = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    seen = dict.fromkeys(w, 0)
    for s, k, slot in M.schedule(w, 500):
        assert seen[s] == k
        seen[s] += 1
        assert all(abs(seen[x] - w[x] * (slot + 1)) < 1 for x in w)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, " Issue" if i % 7 else "ISSUE", 10 + i % 5) for i in range(2000)] + [(5000 + i, "Chat", 20) for i in range(100)] + [(9000 + i, "rfc", 30) for i in range(40)]
    rows += [(9999, None, 5), (None, "issue", 5), (9998, "unknown", 5), (9997, "chat", 0), (9996, "chat", None)]
    records = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").withColumn("slot", F.lit(1))
    targets = spark.createDataFrame([("issue", 0.6, 1), ("chat", 0.3, 2), ("rfc", 0.1, 3), ("mailing_list", 0.2, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    return records, targets, M.mix(records, targets).persist()


def test_shares_and_repeats(mixed):
    records, targets, out = mixed
    got = {r["source"]: r for r in M.shares(out, targets).collect()}
    assert got["issue"]["share"] == pytest.approx(0.6, abs=0.01) and got["chat"]["share"] == pytest.approx(0.3, abs=0.01) and got["rfc"]["share"] == pytest.approx(0.1, abs=0.01)
    assert got["mailing_list"]["n_tokens"] == 0
    assert got["chat"]["most_repeats"] <= 2 and got["issue"]["most_repeats"] == 1 and got["rfc"]["most_repeats"] <= 3
    assert out.groupBy("doc_id", "repeat").count().filter("count > 1").count() == 0


def test_order_follows_the_targets_all_along(mixed):
    rows = mixed[2].orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    total = sum(r["n_tokens"] for r in rows)
    block = total / (max(r["slot"] for r in rows) + 1)
    share = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) / total for s in ("issue", "chat", "rfc")}
    run, all_ = dict.fromkeys(share, 0), 0
    for r in rows:
        run[r["source"]] += r["n_tokens"]
        all_ += r["n_tokens"]
        assert all(abs(run[s] - share[s] * all_) < 2 * block for s in share)


def test_nothing_to_mix(mixed):
    records, targets, _ = mixed
    assert M.mix(records.limit(0), targets).count() == 0
    assert M.mix(records, targets.limit(0)).count() == 0


def test_one_long_text_takes_no_source_away(spark):
    small = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l"]
    rows = [(1000 * j + i, s, 10) for j, s in enumerate(small) for i in range(200)] + [(99_999, "long", 1000)] + [(50_000 + i, "long", 10) for i in range(20)]
    records = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([(s, 0.02 + 0.01 * j, 1) for j, s in enumerate(small)] + [("long", 0.1, 1)], "source string, target_share double, max_repeats int")
    out = M.mix(records, targets)
    got = {r["source"]: r for r in M.shares(out, targets).collect()}
    weight = sum(0.02 + 0.01 * j for j in range(len(small))) + 0.1
    assert all(abs(r["share"] - r["target_share"] / weight) < 0.01 for r in got.values())
    assert got["long"]["n_tokens"] > 0 and got["a"]["n_tokens"] > 0


def test_every_source_gets_the_blocks_that_its_share_begins():
    w = {"a": 0.9, "b": 0.07, "c": 0.03}
    out = M.schedule(w, 5)
    assert {s: sum(x == s for x, _, _ in out) for s in w} == {"a": 5, "b": 1, "c": 1}
    assert [slot for _, _, slot in out] == list(range(7))


def test_exhausted_sources_fall_short_of_a_stated_total(spark):
    have = {"a": (0.5, 1000.0), "b": (0.48, 1000.0), "c": (0.02, 20.0)}
    assert M.quotas(have) == pytest.approx({"a": 500, "b": 480, "c": 20})
    assert M.quotas(have, 1500) == pytest.approx({"a": 1480 * 0.5 / 0.98, "b": 1480 * 0.48 / 0.98, "c": 20})
    assert M.quotas(have, 10_000) == {"a": 1000, "b": 1000, "c": 20}
    rows = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(100)] + [(5000, "c", 10)]
    records = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.48, 1), ("c", 0.02, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in M.shares(M.mix(records, targets, total=10_000), targets, records).collect()}
    assert {s: r["n_tokens"] for s, r in got.items()} == {"a": 1000, "b": 1000, "c": 20} and all(r["unused"] == 0 for r in got.values())
    got = {r["source"]: r for r in M.shares(M.mix(records, targets), targets, records).collect()}
    assert {s for s, r in got.items() if r["limits"]} == {"c"} and got["a"]["unused"] == 500 and got["c"]["available"] == 20


def test_the_end_of_a_quota_is_filled_by_records_that_fit():
    assert M.fill(100, [(0, 90), (90, 500), (590, 8), (598, 5)], 20) == [(0, 0.0), (590, 90.0)]
    assert M.fill(100, [(0, 500), (500, 600)], 20) == [] and M.fill(100, [(0, 150)], 20) == [(0, 0.0)] and M.fill(10, [], 5) == []


def test_a_long_record_at_the_end_of_a_quota(spark):
    rows = [(i, "a", 10) for i in range(900)] + [(2000 + i, "a", 900) for i in range(10)] + [(5000 + i, "b", 10) for i in range(900)]
    records = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    for share in (0.2, 0.35, 0.5, 0.62):
        targets = spark.createDataFrame([("a", share, 1), ("b", 1 - share, 1)], "source string, target_share double, max_repeats int")
        got = {r["source"]: r for r in M.shares(M.mix(records, targets), targets).collect()}
        assert abs(got["a"]["share"] - share) < 0.01


def test_more_records_make_more_parts(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], 10 + i % 7) for i in range(3000)]
    records = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert M._parts(1024, 10**9) == 10_000 and M._parts(1024, 10**3) == 1024 and M._parts(1024, 10**15) == M.MOST
    monkeypatch.setattr(M, "RANGES", 3)
    monkeypatch.setattr(M, "PER_BLOCK", 100)
    out = M.mix(records, targets)
    assert out.count() == out.select("position").distinct().count() and all(abs(r["share"] - 0.5) < 0.01 for r in M.shares(out, targets).collect())
