import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from sextant import cli, config
from sextant.operators import dml, incremental
from sextant.operators.embed import HttpEmbedder, LengthEmbedder, dedup_stats, embed_distinct, query_embedder
from sextant.operators.search import search
from sextant.plans.index_run import chunk_files, index, stats
from sextant.sources.listing import list_files, read_contents
from sextant.sources.store import Store
from sextant.streaming.chunk_stream import read_files, upsert_stream

DIM = 16


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    (root / "main.go").write_text("package main\n\nfunc Add(a, b int) int { return a + b }\n")
    (root / "README.md").write_text("# Title\n\ntext\n\n## Part\n\nmore\n")
    (root / "notes.txt").write_text("some notes\n")
    (root / ".hidden.go").write_text("package h\n")
    (root / "other.java").write_text("class A {}\n")
    (root / "_priv").mkdir()
    (root / "_priv" / "__init__.py").write_text("def f():\n    pass\n")
    (root / ".git").mkdir()
    (root / ".git" / "config.go").write_text("package c\n")
    return root


def run(spark, tree, store):
    return index(spark, str(tree), store, LengthEmbedder(1), LengthEmbedder(1000), dim=DIM, workers=2)


def test_listing(spark, tree):
    got = {os.path.basename(r["path"]): r["language"] for r in list_files(spark, str(tree)).collect()}
    assert got == {"main.go": "go", "README.md": "markdown", "notes.txt": "text", "__init__.py": "python"}


def test_index_then_change_twice_then_delete(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.open_table()
    r = run(spark, tree, store)
    assert (r.new, r.modified, r.deleted) == (4, 0, 0)
    assert stats(store).first().asDict() == {"n_chunks": 5, "n_files": 4, "n_code": 2, "n_docs": 3}
    assert run(spark, tree, store).up_to_date
    time.sleep(0.01)
    (tree / "main.go").write_text("package main\n\nfunc Add(a, b int) int { return b + a }\n\nfunc Sub() {}\n")
    assert run(spark, tree, store).modified == 1
    assert run(spark, tree, store).up_to_date  # a changed file is not indexed again, nor doubled
    assert store.chunks().filter("language = 'go'").count() == 2
    (tree / "notes.txt").unlink()
    assert run(spark, tree, store).deleted == 1
    assert run(spark, tree, store).up_to_date  # a run that only deletes is remembered
    assert store.chunks().filter("file_path like '%notes.txt'").count() == 0
    q = {"code": [0.0] * DIM, "docs": [0.0] * DIM}
    assert {r["embedding_type"] for r in search(store.chunks(), q).collect()} == {"code", "docs"}


def test_store_changes(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run(spark, tree, store)
    store.update("language = 'go'", {"chunk_type": "changed"})
    assert store.chunks().filter("chunk_type = 'changed'").count() == 1
    store.delete("language = 'text'")
    assert store.count() == 4
    rows = store.chunks().limit(1)
    store.append(rows)
    assert store.count() == 5
    store.append(rows.limit(0))
    bad = store.append_checked(rows.withColumn("code", F.lit("")), {"code": F.col("code") != ""})
    assert bad.count() == 1 and store.count() == 5
    store.delete_paths(spark.createDataFrame([(str(tree / "README.md"),)], "p string"))
    assert store.chunks().filter("language = 'markdown'").count() <= 1
    assert store.add_index(["line_start"], "btree") == "line_start_btree" and store.indexes()[0]["kind"] == "btree" and store.indexes()[0]["fresh"]
    with pytest.raises(ValueError):
        store.add_index(["line_start"], "label_list")
    assert len(store.vacuum()) > 0
    store.drop()
    assert not store.exists()


def chunk_rows(spark, n, start=0, dim=8):
    return spark.range(start, start + n).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("/p/"), (F.col("id") % 7).cast("string")).alias("file_path"), F.col("id").cast("int").alias("line_start"), F.col("id").cast("int").alias("line_end"),
        F.when(F.col("id") % 3 == 0, "go").otherwise("python").alias("language"), F.concat(F.lit("code number "), "id").alias("code"), F.lit("f").alias("chunk_type"), F.lit("").alias("heading"), F.lit("").alias("heading_level"),
        F.lit("").alias("parent_heading"), F.lit("code").alias("embedding_type"), F.lit("n").alias("name"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"),
        F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: F.sin(j * F.col("id")).cast("float")).alias("vector"),
    )


def parquet_files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path / "chunks") for f in names if f.endswith(".parquet")}


def test_a_change_touches_only_its_own_files(spark, tmp_path):
    path = tmp_path / "store"
    store = Store(spark, str(path))
    store.append(chunk_rows(spark, 50).coalesce(2))
    before = parquet_files(path)
    store.append(chunk_rows(spark, 1, 50))
    after = parquet_files(path)
    assert before < after and len(after - before) == 1 and store.count() == 51
    store.upsert(spark.createDataFrame([("/p/3",)], "p string"), chunk_rows(spark, 1, 59).withColumn("file_path", F.lit("/p/3")))
    assert before < parquet_files(path) and len(parquet_files(path) - after) == 1
    assert [r["chunk_id"] for r in store.chunks().filter("file_path = '/p/3'").collect()] == ["c59"]
    store.append(chunk_rows(spark, 1, 3))  # a path that was deleted may come again
    assert store.chunks().filter("file_path = '/p/3'").count() == 2
    n = store.count()
    store.delete("chunk_id = 'c59'")
    assert store.count() == n - 1 and before < parquet_files(path)  # the large commit was not written again
    store.compact()
    assert store.count() == n - 1 and len(store.vacuum()) > 0 and store.count() == n - 1


def test_writers_wait_for_each_other(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    errors = []

    def insert(k):
        try:
            Store(spark, store.path).append(chunk_rows(spark, 5, 5 * k))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=insert, args=(k,)) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and store.count() == 25 and store.chunks().select("chunk_id").distinct().count() == 25
    (tmp_path / "store" / "writer.lock").write_text("left behind")
    with pytest.raises(TimeoutError):
        Store(spark, store.path, wait=0.3).append(chunk_rows(spark, 1, 90))
    time.sleep(0.05)
    Store(spark, store.path, stale=0.01).append(chunk_rows(spark, 1, 90))
    assert store.count() == 26


def test_indexes_are_built_and_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append(chunk_rows(spark, 300).filter("language = 'go'").coalesce(1))
    store.append(chunk_rows(spark, 300).filter("language = 'python'").coalesce(1))
    plain = {r["value"]: r["n"] for r in store.value_counts("language").collect()}
    store.add_index(["language"], "bitmap")
    store.add_index(["code"], "fts")
    store.add_index(["vector"], "ivf_flat")
    assert {i["kind"]: i["fresh"] for i in store.indexes()} == {"bitmap": True, "fts": True, "ivf_flat": True}
    assert {r["value"]: r["n"] for r in store.value_counts("language").collect()} == plain == {"go": 100, "python": 200}
    assert "/chunks/" not in store.value_counts("language")._jdf.queryExecution().toString()
    go = store.where("language", ["go"])
    assert go.count() == 100 and len(go.inputFiles()) == 1 and store.where("language", ["absent"]).count() == 0
    assert [r["id"] for r in store.search_words(["17"]).collect()] == ["c17"]
    q = [float(x) for x in store.chunks().filter("chunk_id = 'c42'").first()["vector"]]
    assert store.nearest(q, 1).first()["chunk_id"] == "c42"
    store.append(chunk_rows(spark, 3, 300))  # indexes of older content are not used any more
    assert not any(i["fresh"] for i in store.indexes())
    assert {r["value"]: r["n"] for r in store.value_counts("language").collect()} == {"go": 101, "python": 202}
    with pytest.raises(ValueError):
        store.search_words(["17"])
    assert store.nearest(q, 1).first()["chunk_id"] == "c42" and store.where("language", ["go"]).count() == 101
    store.drop_index("code_fts")
    assert {i["kind"] for i in store.indexes()} == {"bitmap", "ivf_flat"}


def test_btree_order_is_kept_by_later_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append(chunk_rows(spark, 20))
    store.add_index(["line_start"], "btree")
    store.append(chunk_rows(spark, 20, 20).orderBy(F.desc("line_start")))
    store.vacuum()
    for f in parquet_files(tmp_path / "store"):
        got = [r[0] for r in spark.read.parquet(f).select("line_start").collect()]
        assert got == sorted(got)


def test_refused_rows_are_kept_apart(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append_checked(chunk_rows(spark, 5), {"go": F.col("language") == "go"})
    assert store.count() == 2 and store.quarantined().count() == 3
    assert {tuple(r["broken_rules"]) for r in store.quarantined().collect()} == {("go",)}


def test_unknown_languages_fail_the_run(spark):
    files = spark.createDataFrame([("a.zig", "zig", "x"), ("b.txt", "text", "y")], "path string, language string, content string")
    with pytest.raises(Exception, match="no chunker for language zig"):
        chunk_files(files).collect()
    assert chunk_files(files.filter("language = 'text'")).first()["language"] == "text"


def test_a_hadoop_path(spark, tree, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.append(chunk_rows(spark, 4))
    assert Store(spark, f"file://{tmp_path}/store").count() == 4
    assert list_files(spark, f"file://{tree}").count() == 4
    assert read_contents(list_files(spark, f"file://{tree}")).filter("path like '%notes.txt'").first()["content"] == "some notes\n"


def test_schema_version_is_checked(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"schema_version": 99, "snapshot": null, "files": null}')
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).manifest()


def test_plan_with_nulls(spark):
    t = lambda x: x and f"2024-01-01 00:00:00.{x}"
    scan = spark.createDataFrame([("a", t("000002")), ("b", t("000001")), ("c", None), ("d", t("1")), (None, t("1")), ("a", t("000001"))], "path string, m string")
    old = spark.createDataFrame([("a", t("000001")), ("b", t("000001")), ("c", t("1")), ("e", t("1")), ("d", None)], "path string, m string")
    cast = lambda df: df.select("path", F.col("m").cast("timestamp").alias("mod_time"))
    got = {r["path"]: r["action"] for r in incremental.plan(cast(scan), cast(old)).collect()}
    assert got == {"a": "modified", "b": "unchanged", "c": "unchanged", "d": "modified", "e": "deleted"}


def test_users_table(spark):
    rows = [(1, "A", 85.5, True), (2, "B", 92.0, True), (3, "C", 78.5, True), (4, "D", 88.0, False), (5, "E", 95.5, True)]
    users = spark.createDataFrame(rows, "id int, name string, score double, active boolean")
    assert users.filter("score > 85").count() == 4
    users = dml.update(users, "id = 1", {"score": 95})
    users = dml.delete(dml.delete(users, "active = false"), F.col("score") < 80)
    assert sorted(r["id"] for r in users.collect()) == [1, 2, 5]
    with pytest.raises(ValueError):
        dml.update(users, "id = 1", {"nothing": 1})


def test_null_predicates_change_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "id int, v int")
    assert dml.delete(df, "v > 0").count() == 1
    assert [r["v"] for r in dml.update(df, "v > 0", {"v": 9}).orderBy("id").collect()] == [None, 9]
    with pytest.raises(Exception, match="rule broken"):
        dml.require(df, {"v": F.col("v") > 0}).collect()


def test_each_text_is_embedded_once(spark):
    class Counting(LengthEmbedder):
        def embed_many(self, texts):
            assert len(set(texts)) == len(texts)
            return [[float(len(t.encode()) + 1), float(sum(map(ord, t)) + 1)] for t in texts]

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("", 5)], "code string, n int")
    got = {r["n"]: r["vector"] for r in embed_distinct(df, Counting(), dim=3, workers=1).collect()}
    assert got[1] == got[2] == [2.0, 98.0, 0.0] and got[4] is None and got[5] == [1.0, 1.0, 0.0]
    assert dedup_stats(df).first().asDict() == {"total_rows": 4, "unique_rows": 3, "duplicate_rows": 1}


def test_http_retries_then_sorts(monkeypatch):
    calls = []

    def post(self, texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError("busy")
        return [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]

    monkeypatch.setattr(HttpEmbedder, "_post", post)
    e = HttpEmbedder("http://x/v1/", "m", waits=(0.0, 0.0))
    assert e.url == "http://x/v1/embeddings"
    assert e.embed_many(["a", "b"]) == [[1.0], [2.0]] and len(calls) == 3
    with pytest.raises(ValueError):
        e.embed_many(["a"])
    assert query_embedder(LengthEmbedder())("ab") == (3.0, 196.0)


def test_config(tmp_path):
    user, project = tmp_path / "u.json", tmp_path / "p.json"
    user.write_text('{"endpoint": "https://a/", "code_model": "u", "unknown": 1}')
    project.write_text('{"code_model": "p", "text_model": ""}')
    c = config.load(str(user), str(project), {"text_model": "f"})
    assert (c.endpoint, c.code_model, c.text_model) == ("https://a", "p", "f")
    for bad in ({"endpoint": "ftp://x"},):
        with pytest.raises(ValueError):
            config.load(str(user), str(project), bad)
    project.write_text("{")
    with pytest.raises(ValueError):
        config.load(str(user), str(project))
    c.save(str(tmp_path / "d" / "c.json"))
    assert config.load(str(tmp_path / "d" / "c.json"), "none").endpoint == "https://a"


def test_stream_upserts(spark, tmp_path):
    store, inbox = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")

    def arrive(*rows):
        df = spark.createDataFrame(list(rows), "path string, language string, content string, t string")
        df.select("path", "language", "content", F.col("t").cast("timestamp").alias("mod_time")).coalesce(1).write.mode("append").parquet(inbox)

    def step():
        q = upsert_stream(read_files(spark, inbox), store, LengthEmbedder(), LengthEmbedder(), str(tmp_path / "cp"), dim=DIM)
        q.awaitTermination(120)

    arrive(("a.txt", "text", "one", "2024-01-01"), ("a.txt", "text", "two", "2024-01-02"), ("b.md", "markdown", "# H\nx", None))
    step()
    assert sorted(r["code"] for r in store.chunks().collect()) == ["# H\nx", "two"]
    arrive(("a.txt", "text", None, "2024-01-03"))
    step()
    assert [r["code"] for r in store.chunks().collect()] == ["# H\nx"] and store.files().count() == 1


def test_cli(spark, tree, capsys):
    assert cli.main(["--root", str(tree), "--offline", "index", "-w", "2"]) == 0
    assert "4 new" in capsys.readouterr().out
    assert cli.main(["--root", str(tree), "--offline", "search", "notes", "--docs", "--limit", "2"]) == 0
    assert capsys.readouterr().out.startswith("1. ")
    assert cli.main(["--root", str(tree), "--offline", "search", "notes", "--json"]) == 0
    assert '"mode" : "hybrid"' in capsys.readouterr().out
    assert cli.main(["--root", str(tree), "--offline", "stats"]) == 0
