import os

from sextant import session as S


def test_scratch_tables_are_written_and_removed(spark):
    df = S.materialise(spark.range(3), "test")
    path = df.inputFiles()[0].removeprefix("file:").lstrip("/")
    assert os.path.exists("/" + path) and df.count() == 3
    assert S.clear_scratch(spark) >= 1 and not os.path.exists("/" + path)
    assert S.clear_scratch(spark) == 0


def test_an_index_is_built_once_for_the_same_files(spark, tmp_path):
    built = []
    spark.range(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    first = S.stored(df, "x", built.append)
    assert S.stored(spark.read.parquet(str(tmp_path / "t")), "x", built.append) == first and built == [first]
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert S.stored(spark.read.parquet(str(tmp_path / "t")), "x", built.append) != first and len(built) == 2
    S.clear_scratch(spark)


def test_only_small_inputs_are_spread(spark, monkeypatch):
    df = spark.range(100).coalesce(1)
    assert S.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(S, "SPREAD_LIMIT", 10)
    assert S.spread(df).rdd.getNumPartitions() == 1


def test_the_package_is_shipped_once(spark, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", "")
    S.ship(spark)
    assert spark.sparkContext._sextant_shipped
    assert spark.range(2).mapInPandas(lambda parts: (p.assign(id=__import__("sextant").__name__ == "sextant") for p in parts), "id boolean").first()[0]
