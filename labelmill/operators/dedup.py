"""Row dedup by key, upsert and other changes of a table's state, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column], null_keys: str = "keep") -> DataFrame:
    """One row of each key, the first in ``order``.

    null_keys: 'keep' leaves rows with a null key part alone, 'collapse' treats null as a value.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    ranked = df if null_keys == "collapse" else df.where(whole)
    # A plain limit on the rank lets each task drop rows of a hot key before they are shuffled.
    first = ranked.withColumn("rank_in_key", rank).where("rank_in_key = 1").drop("rank_in_key")
    return first if null_keys == "collapse" else first.unionByName(df.where(~whole))


def keep_latest(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    return keep_one(df, keys, [F.col(id_column).desc()])


def keep_earliest(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    return keep_one(df, keys, [F.col(id_column).asc()], "collapse")


def keep_latest_or(df: DataFrame, key: str, fallback: str, id_column: str) -> DataFrame:
    """Latest row per key; rows without it per fallback key; rows without both stay."""
    first = keep_latest(df.where(F.col(key).isNotNull()), [key], id_column)
    return first.unionByName(keep_latest(df.where(F.col(key).isNull()), [fallback], id_column))


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target with incoming rows in place of those of equal key; of several incoming rows the first in order."""
    new = keep_one(incoming, keys, order, "collapse").select(*target.columns)
    return target.join(new.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target and the incoming rows whose key it lacks; of several the first in order."""
    new = keep_one(incoming, keys, order, "collapse").join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def patch(target: DataFrame, changes: DataFrame, key: str, columns: list[str], overwrite: bool = False, order: list[Column] | None = None) -> DataFrame:
    """target with columns filled from changes where null (or wherever changes has a value, with overwrite).

    Of several changes of one key the first in ``order`` is taken, whole; without an order, the one of the
    smallest values, nulls last. A null key changes nothing. Rows stay as many as they were.
    """
    known = keep_one(changes.where(F.col(key).isNotNull()), [key], order or [F.col(c).asc_nulls_last() for c in columns])
    new = known.select(F.col(key).alias("patch_key"), *(F.col(c).alias(f"patch_{c}") for c in columns))
    joined = target.join(new, F.col(key) == F.col("patch_key"), "left")
    pick = lambda c: F.coalesce(f"patch_{c}", c) if overwrite else F.coalesce(c, f"patch_{c}")
    return joined.select(*(pick(c).alias(c) if c in columns else F.col(c) for c in target.columns))


def cleared(df: DataFrame, **values) -> DataFrame:
    """df without the rows that have all of these values, so that a step can be run again; null is unequal."""
    same = F.lit(True)
    for name, value in values.items():
        same = same & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return df.where(~same)


def missing_keys(wanted: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``wanted`` that ``staged`` lacks."""
    return wanted.select(*keys).distinct().join(staged.select(*keys), keys, "left_anti")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
