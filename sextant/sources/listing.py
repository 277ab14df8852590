"""Files of a directory tree as a DataFrame, by a Python data source.

Roots are local folders or addresses that pyarrow's file systems know (``hdfs://``, ``s3://`` and the like).
Folders below the root are listed by tasks, one per first-level folder; where there are fewer than ``SPLIT`` of them, one per second-level folder.  Hidden names (with a leading dot) are left
out below the root only; names with a leading underscore stay, which Spark's own file sources would drop.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sextant.functions.lang import STRICT, scanner_language


#: First-level folders from which on each is one task.
SPLIT = 16


def file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what goes before it in full paths."""
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else path.split("://")[0] + "://"


def _entries(system: fs.FileSystem, folder: str) -> tuple[list[str], list[fs.FileInfo]]:
    """Folders and files right below a folder, without hidden ones, in order. Links to folders are not followed."""
    found = sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda e: e.path)
    seen = [e for e in found if not e.base_name.startswith(".")]
    local = isinstance(system, fs.LocalFileSystem)
    folders = [e.path for e in seen if e.type == fs.FileType.Directory and not (local and os.path.islink(e.path))]
    return folders, [e for e in seen if e.type == fs.FileType.File]


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        system, inside, _ = file_system(self.root)
        flat, deep = [inside], _entries(system, inside)[0]
        if len(deep) < SPLIT:
            flat += deep
            deep = [f for d in deep for f in _entries(system, d)[0]]
        return [*(_Folder(p, False) for p in flat), *(_Folder(p, True) for p in deep)]

    def read(self, part: _Folder) -> Iterator[tuple]:
        system, _, head = file_system(self.root)
        todo = [part.path]
        while todo:
            folders, files = _entries(system, todo.pop())
            if part.deep:
                todo += reversed(folders)
            for e in files:
                yield head + e.path, datetime.fromtimestamp(e.mtime_ns // 1000 / 1e6, timezone.utc)


class TreeSource(DataSource):
    """``spark.read.format("tree").option("root", folder)``: path and mod_time of every file that is not hidden."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, mod_time timestamp"

    def reader(self, schema) -> DataSourceReader:
        root = self.options["root"]
        return _Reader(root if "://" in root else os.path.abspath(root))


def list_files(spark: SparkSession, root: str, table: dict[str, str] = STRICT) -> DataFrame:
    """(path, language, mod_time) of the files whose extension is in ``table``."""
    spark.dataSource.register(TreeSource)
    files = spark.read.format("tree").option("root", root).load()
    return files.withColumn("language", scanner_language(F.col("path"), table)).filter("language IS NOT NULL").select("path", "language", "mod_time")


def read_contents(files: DataFrame, workers: int = 32) -> DataFrame:
    """``files`` with ``content``: each file read whole as UTF-8 where its task runs (undecodable bytes are replaced)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = []
            for path in p["path"]:
                system, inside, _ = file_system(path)
                with system.open_input_stream(inside) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield p.assign(content=texts)

    schema = files.select("*", F.lit("").alias("content")).schema
    return files.repartition(workers, "path").mapInPandas(run, schema)


scan_python_files = list_files  # the old name
