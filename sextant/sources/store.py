"""A chunk table as Parquet folders, one per change, named by a manifest; any Hadoop path.

The table lies in ``chunks/commit=<id>/embedding_type=<side>/``, so that Spark prunes both.  An append writes only its own rows; an upsert or a delete by path writes its
rows and a list of paths, whose rows in older commits no longer count; an update or delete by predicate writes anew only the commits that hold such rows.
:meth:`Store.compact` makes one commit of all.  The manifest is swapped by one rename, so readers see a change whole or not at all.

One writer at a time holds the lock; others wait for it.  A lock that is older than ``STALE`` seconds is of a writer that died.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.operators import ann, dml, fulltext
from sextant.operators.knn import knn
from sextant.schema import CHUNKS, FILES, SCHEMA_VERSION

#: Seconds that a writer waits for the lock, and after which a lock counts as left behind.
WAIT, STALE = 600.0, 6 * 3600.0
INDEX_KINDS = ("btree", "bitmap", "fts", *ann.KINDS)


class Store:
    def __init__(self, spark: SparkSession, path: str, wait: float = WAIT, stale: float = STALE):
        self.spark, self.path, self.wait, self.stale = spark, path.rstrip("/"), wait, stale
        self._held = 0
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    # -------------------------------------------------------------- manifest

    def manifest(self) -> dict:
        """The current state; without one, an empty store."""
        at = self._at("manifest.json")
        if not self._fs.exists(at):
            return {"schema_version": SCHEMA_VERSION, "next": 0, "commits": [], "deletes": [], "exists": False, "files": None, "last_index_time": None, "indexes": []}
        found = json.loads(self._read_text(at))
        if found["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"the store has schema version {found['schema_version']}, this code {SCHEMA_VERSION}")
        return found

    def _read_text(self, at) -> str:
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, at, text: str, overwrite: bool) -> None:
        stream = self._fs.create(at, overwrite)
        stream.write(text.encode())
        stream.close()

    def _commit(self, state: dict) -> None:
        temp = self._at(f"manifest.{uuid.uuid4().hex}")
        self._write_text(temp, json.dumps(state, indent=2), False)
        rename = self._hadoop.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._hadoop.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self._conf).rename(self._fs.makeQualified(temp), self._fs.makeQualified(self._at("manifest.json")), how)

    def _take(self, at) -> bool:
        """Makes the lock, if there is none; atomic on local file systems and on those of a cluster."""
        if self._fs.getUri().getScheme() == "file":
            try:
                os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            self._write_text(at, "", False)
            return True
        except Exception:
            if self._fs.exists(at):
                return False
            raise

    def _age(self, at) -> float:
        """Seconds since a file was written; 0 if it has gone meanwhile."""
        try:
            return time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000
        except Exception:
            if self._fs.exists(at):
                raise
            return 0.0

    @contextmanager
    def writing(self):
        """Holds the lock; a writer that already has it goes on."""
        if self._held == 0:
            at, until = self._at("writer.lock"), time.monotonic() + self.wait
            while not self._take(at):
                if self._age(at) > self.stale:
                    self._fs.delete(at, False)
                elif time.monotonic() > until:
                    raise TimeoutError(f"another writer holds {self.path}")
                else:
                    time.sleep(0.1)
        self._held += 1
        try:
            yield self
        finally:
            self._held -= 1
            if self._held == 0:
                self._fs.delete(self._at("writer.lock"), False)

    # -------------------------------------------------------------- reading

    def exists(self) -> bool:
        return self.manifest()["exists"]

    def _read(self, commits: Sequence[str]) -> DataFrame:
        """Rows of some commits, with the column ``commit``."""
        schema = T.StructType([*CHUNKS.fields, T.StructField("commit", T.StringType())])
        if not commits:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/chunks/commit={c}" for c in commits]
        names = [f.name for f in schema.fields]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/chunks").parquet(*folders).select(*names)

    def _visible(self, state: dict) -> DataFrame:
        commits, deletes = state["commits"], state["deletes"]
        last = max((d["seq"] for d in deletes), default=-1)
        young = self._read([c["id"] for c in commits if c["seq"] > last])
        old = [c for c in commits if c["seq"] < last]
        if not old:
            return young
        # a list of paths hides the rows of commits before it
        lists = [self.spark.read.schema("file_path string").parquet(f"{self.path}/{d['name']}").withColumn("until", F.lit(d["seq"])) for d in deletes]
        gone = lists[0]
        for more in lists[1:]:
            gone = gone.unionByName(more)
        gone = gone.groupBy("file_path").agg(F.max("until").alias("until"))
        seq = F.create_map(*[F.lit(x) for c in old for x in (c["id"], c["seq"])])
        rows = self._read([c["id"] for c in old]).withColumn("seq", F.try_element_at(seq, F.col("commit")))
        kept = rows.join(gone, (rows["file_path"] == gone["file_path"]) & (rows["seq"] < gone["until"]), "left_anti").drop("seq")
        return kept.unionByName(young)

    def chunks(self) -> DataFrame:
        """The table; filters on embedding_type prune folders."""
        return self._visible(self.manifest()).drop("commit")

    def open_table(self) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError("no table here: run index first")
        return self.chunks()

    def files(self) -> DataFrame:
        name = self.manifest()["files"]
        return self.spark.createDataFrame([], FILES) if name is None else self.spark.read.schema(FILES).parquet(f"{self.path}/{name}")

    def count(self) -> int:
        return self.chunks().count()

    # -------------------------------------------------------------- writing

    def _add(self, state: dict, chunks: DataFrame) -> None:
        """Writes the rows as a commit, sorted as the btree indexes ask."""
        name = uuid.uuid4().hex
        rows = chunks.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS.fields])
        order = [c for i in state["indexes"] if i["kind"] == "btree" for c in i["columns"]]
        if order:  # readers skip row groups by their bounds
            rows = rows.repartitionByRange(*order).sortWithinPartitions("embedding_type", *order)
        rows.write.partitionBy("embedding_type").parquet(f"{self.path}/chunks/commit={name}")
        state["commits"].append({"id": name, "seq": state["next"]})
        state["next"] += 1
        state["exists"] = True

    def _files(self, state: dict, files: DataFrame | None, at: datetime | None) -> None:
        if files is not None:
            state["files"] = f"files-{uuid.uuid4().hex}"
            files.select(*[f.name for f in FILES.fields]).write.parquet(f"{self.path}/{state['files']}")
            state["last_index_time"] = (at or datetime.now(timezone.utc)).isoformat()

    def replace(self, chunks: DataFrame, files: DataFrame | None = None, at: datetime | None = None) -> None:
        """The whole content anew, in one commit."""
        with self.writing():
            state = self.manifest()
            state["commits"] = []
            self._add(state, chunks)
            self._files(state, files, at)
            self._commit(state | {"deletes": []})

    def compact(self) -> None:
        """One commit of all, without what is deleted."""
        with self.writing():
            self.replace(self.chunks())

    def append(self, chunks: DataFrame, files: DataFrame | None = None) -> None:
        """Rows added as a commit of their own; an empty frame changes nothing."""
        if chunks.isEmpty():
            return
        with self.writing():
            state = self.manifest()
            self._add(state, chunks)
            self._files(state, files, None)
            self._commit(state)

    def upsert(self, paths: DataFrame, fresh: DataFrame | None, files: DataFrame | None = None, at: datetime | None = None) -> None:
        """Stored rows of ``paths`` (one column) go, the fresh rows come, in one commit."""
        with self.writing():
            state = self.manifest()
            name = f"deletes-{uuid.uuid4().hex}"
            paths.select(F.col(paths.columns[0]).alias("file_path")).filter("file_path IS NOT NULL").distinct().write.parquet(f"{self.path}/{name}")
            state["deletes"].append({"name": name, "seq": state["next"]})
            state["next"] += 1
            if fresh is not None:
                self._add(state, fresh)
            self._files(state, files, at)
            self._commit(state)

    def delete_paths(self, paths: DataFrame) -> None:
        self.upsert(paths, None)

    def _rewrite(self, where: Column | str, step: Callable[[DataFrame], DataFrame]) -> None:
        """``step`` over the commits that hold rows passing ``where``; the others stay as they are."""
        with self.writing():
            state = self.manifest()
            rows = self._visible(state)
            hit = F.expr(where) if isinstance(where, str) else where
            touched = {r[0] for r in rows.filter(hit).select("commit").distinct().collect()}  # commits at most
            if touched:
                state["commits"] = [c for c in state["commits"] if c["id"] not in touched]
                self._add(state, step(rows.filter(F.col("commit").isin(sorted(touched))).drop("commit")))
                self._commit(state)

    def update(self, where: Column | str, values: dict[str, object]) -> None:
        self._rewrite(where, lambda df: dml.update(df, where, values))

    def delete(self, where: Column | str) -> None:
        self._rewrite(where, lambda df: dml.delete(df, where))

    def append_checked(self, chunks: DataFrame, rules: dict[str, Column], quarantine: bool = True) -> DataFrame:
        """Good rows are added; the bad ones, with the rules they break, go to the folder ``quarantine`` and come back."""
        good, bad = dml.validated(chunks, rules)
        if quarantine:
            bad.write.mode("append").parquet(f"{self.path}/quarantine")
        self.append(good)
        return bad

    def quarantined(self) -> DataFrame:
        """All rows that were refused so far."""
        return self.spark.read.parquet(f"{self.path}/quarantine")

    def vacuum(self) -> list[str]:
        """Removes folders that the manifest no longer names."""
        with self.writing():
            state = self.manifest()
            named = {f"commit={c['id']}" for c in state["commits"]} | {d["name"] for d in state["deletes"]} | {state["files"]} | {i["folder"] for i in state["indexes"]}
            old = []
            for below in ("", "chunks"):
                at = self._at(below)
                for f in self._fs.listStatus(at) if self._fs.exists(at) else ():
                    n = f.getPath().getName()
                    if n.startswith(("commit=", "deletes-", "files-", "index-")) and n not in named:
                        self._fs.delete(f.getPath(), True)
                        old.append(n)
            return old

    def drop(self) -> None:
        with self.writing():
            state = self.manifest()
            self._commit(state | {"commits": [], "deletes": [], "exists": False, "files": None, "last_index_time": None, "indexes": []})
            self.vacuum()

    # -------------------------------------------------------------- indexes

    def add_index(self, columns: list[str], kind: str, name: str | None = None, **options) -> str:
        """Builds an index: btree sorts the table, and every later commit, by the columns; the others are tables of their own.

        They answer for the content they were built from. After a change searches take the plain way until the index is built again.
        """
        if kind not in INDEX_KINDS:
            raise ValueError(f"index kind {kind} is not supported")
        known = {f.name for f in CHUNKS.fields}
        if lost := [c for c in columns if c not in known]:
            raise ValueError(f"no such columns: {lost}")
        name = name or "_".join([*columns, kind])
        with self.writing():
            state = self.manifest()
            entry = {"name": name, "columns": columns, "kind": kind, "folder": f"index-{uuid.uuid4().hex}"}
            state["indexes"] = [i for i in state["indexes"] if i["name"] != name] + [entry]
            to = f"{self.path}/{entry['folder']}"
            if kind == "btree":
                self._commit(state)
                self.compact()
                return name
            if kind == "bitmap":
                self._bitmaps(state, columns[0]).write.parquet(to)
            elif kind == "fts":
                fulltext.build(self.chunks(), to, "chunk_id", columns[0])
            else:
                size = self.chunks().select(F.size(columns[0])).limit(1).first()
                ann.build(self.chunks(), to, kind, "chunk_id", columns[0], dim=size[0] if size else 1, **options)
            entry["next"] = state["next"]
            self._commit(state)
        return name

    def indexes(self) -> list[dict]:
        """The catalogue; ``fresh`` says whether an index answers for the present content."""
        state = self.manifest()
        return [i | {"fresh": i["kind"] == "btree" or i.get("next") == state["next"]} for i in state["indexes"]]

    def drop_index(self, name: str) -> None:
        with self.writing():
            state = self.manifest()
            self._commit(state | {"indexes": [i for i in state["indexes"] if i["name"] != name]})

    def _index(self, column: str, *kinds: str) -> str | None:
        for i in self.indexes():
            if i["kind"] in kinds and i["columns"][0] == column and i["fresh"]:
                return f"{self.path}/{i['folder']}"
        return None

    def _bitmaps(self, state: dict, column: str) -> DataFrame:
        """(value, file, bucket, rows): for each value and file a bitmap of the rows that hold it."""
        if state["deletes"]:
            raise ValueError("compact the store before a bitmap index is built")
        folders = [f"{self.path}/chunks/commit={c['id']}" for c in state["commits"]]
        rows = self.spark.read.schema(CHUNKS).option("basePath", f"{self.path}/chunks").parquet(*folders) if folders else self.spark.createDataFrame([], CHUNKS)
        at = F.col("_metadata.row_index") + 1 if folders else F.lit(1)
        file = F.col("_metadata.file_path") if folders else F.lit("")
        keyed = rows.select(F.col(column).cast("string").alias("value"), file.alias("file"), at.cast("long").alias("at"))
        return keyed.groupBy("value", "file", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("rows"))

    def value_counts(self, column: str) -> DataFrame:
        """(value, n): from the bitmap index alone where there is a fresh one."""
        if path := self._index(column, "bitmap"):
            return self.spark.read.parquet(path).groupBy("value").agg(F.sum(F.bitmap_count("rows")).alias("n"))
        return self.chunks().groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))

    def where(self, column: str, values: Sequence) -> DataFrame:
        """Rows with one of the values: with a fresh bitmap index only the files that hold one are read."""
        wanted = [str(v) for v in values]
        if path := self._index(column, "bitmap"):
            files = [r[0] for r in self.spark.read.parquet(path).filter(F.col("value").isin(wanted)).select("file").distinct().collect()]  # names of files
            if not files:
                return self.spark.createDataFrame([], CHUNKS)
            read = self.spark.read.schema(CHUNKS).option("basePath", f"{self.path}/chunks").parquet(*files)
            return read.select(*[f.name for f in CHUNKS.fields]).filter(F.col(column).cast("string").isin(wanted))
        return self.chunks().filter(F.col(column).cast("string").isin(wanted))

    def search_words(self, terms: Sequence[str], column: str = "code", k: int = 20) -> DataFrame:
        """(id, score) by BM25 from the stored full-text index."""
        path = self._index(column, "fts")
        if path is None:
            raise ValueError(f"no fresh full-text index on {column}")
        return fulltext.search(self.spark, path, terms, k)

    def nearest(self, query: Sequence[float], k: int = 10, column: str = "vector") -> DataFrame:
        """(chunk_id, score) of the nearest rows: by a fresh vector index, else exactly."""
        if path := self._index(column, *ann.KINDS):
            return ann.Index(self.spark, path).search(query, k).select(F.col("id").alias("chunk_id"), "score")
        return knn(self.chunks(), query, k, columns=["chunk_id"], vector=column)
