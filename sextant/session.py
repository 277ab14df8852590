"""Session helpers: a local session for tests and tools, and the shared scratch folder."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "sextant") -> SparkSession:
    """A local session with the settings that every query here expects."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SEXTANT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset, as in
    local tests, a temporary folder of this machine is made and kept for the session.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_sextant_scratch", []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear_scratch(spark: SparkSession) -> int:
    """Removes the intermediate tables and indexes that this session wrote. Only for when no result that reads them is still to be computed."""
    sc = spark.sparkContext
    gone = sc.__dict__.pop("_sextant_scratch", []) + list(sc.__dict__.pop("_sextant_stored", {}).values())
    for path in gone:
        at, fs = _file_system(spark, path)
        fs.delete(at, True)
    return len(gone)


#: Bytes of an input that are shuffled at most for the sake of more parts.
SPREAD_LIMIT = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small ``df`` over at least as many partitions as there are cores, for work that is heavy for each row.

    Inputs that already have as many parts are left alone, and so are large ones, which come in enough of them: nothing large is shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores or int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SPREAD_LIMIT:
        return df
    return df.repartition(cores)


def stored(df: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The folder of an index over ``df``, which ``build`` writes once in a session for the same input files."""
    spark = df.sparkSession
    sc = spark.sparkContext
    marks = []
    for f in sorted(df.inputFiles()):
        at, fs = _file_system(spark, f)
        status = fs.getFileStatus(at)
        marks.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    key = (name, hashlib.sha256("\n".join(marks).encode()).hexdigest())
    held = sc.__dict__.setdefault("_sextant_stored", {})
    if key not in held:
        path = f"{scratch_dir(spark)}/index-{name}-{uuid.uuid4().hex}"
        build(path)
        held[key] = path
    return held[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, where their path does not hold it anyway."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_sextant_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "sextant")):
            for n in sorted(names):
                if n.endswith((".py", ".txt")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    path = f"{scratch_dir(spark)}/code-{uuid.uuid4().hex}/sextant.zip"
    at, fs = _file_system(spark, path)
    stream = fs.create(at, True)
    stream.write(packed.getvalue())
    stream.close()
    sc.addPyFile(path)
    sc._sextant_shipped = True
