"""Changes of a table as pure transforms (copy-on-write; the store commits the result)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pred(p: Column | str) -> Column:
    return F.coalesce(F.expr(p) if isinstance(p, str) else p, F.lit(False))


def update(df: DataFrame, where: Column | str, values: dict[str, object]) -> DataFrame:
    """Rows that pass ``where`` get the values: literals, or Columns over the old row. A null predicate changes nothing."""
    types = dict(df.dtypes)
    if missing := set(values) - set(types):
        raise ValueError(f"no such columns: {sorted(missing)}")
    hit = _pred(where)
    new = {c: (v if isinstance(v, Column) else F.lit(v)).cast(types[c]) for c, v in values.items()}
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def update_all(df: DataFrame, steps: Sequence[tuple[Column | str, dict[str, object]]]) -> DataFrame:
    """Updates in order; a later one sees what earlier ones changed."""
    for where, values in steps:
        df = update(df, where, values)
    return df


def delete(df: DataFrame, where: Column | str) -> DataFrame:
    """Without the rows that pass ``where``; rows for which it is null stay."""
    return df.filter(~_pred(where))


def delete_paths(df: DataFrame, paths: DataFrame, key: str = "file_path") -> DataFrame:
    """Without the rows of the given paths (one column). Spark broadcasts the list only if it is small."""
    gone = paths.select(F.col(paths.columns[0]).alias(key)).distinct()
    return df.join(gone, key, "left_anti").select(*df.columns)


def page(df: DataFrame, key: str | Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """A page in key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).offset(offset).limit(limit)


def validated(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the list of broken rules. A rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    tagged = df.withColumn("broken_rules", broken)
    return tagged.filter(F.size("broken_rules") == 0).select(*df.columns), tagged.filter(F.size("broken_rules") > 0)


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The frame itself; the first row that breaks a rule fails the job, so nothing of the batch is written."""
    for name, rule in rules.items():
        df = df.filter(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean")))
    return df
