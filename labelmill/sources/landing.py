"""Landing tables: reading sources, staging them with their raw form, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from labelmill.functions.normalize import blank_to_null
from labelmill.operators.dedup import keep_one, missing_keys


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records from a folder of JSON pages, each page an array or lines of objects."""
    return spark.read.option("multiLine", True).json(path)


def stage(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Typed landing rows: trimmed columns by new name (blank: null), and raw_data, the whole row as JSON."""
    return df.select(*(blank_to_null(F.col(old).cast("string")).alias(new) for new, old in columns.items()), F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias("raw_data"))


def first_filled(*names: str, of: DataFrame) -> Column:
    """The first of several header names that is there and not blank."""
    return F.coalesce(*(blank_to_null(F.col(f"`{n}`").cast("string")) for n in names if n in of.columns), F.lit(None).cast("string"))


def map_records(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Records under canonical names, each from the first filled of its headers."""
    return df.select(*(first_filled(*names, of=df).alias(new) for new, names in aliases.items()))


def merged_dictionary(default: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Default entries, with stored ones in their place and besides."""
    other = stored.select(F.col(key).alias("stored_key"), *(F.col(c).alias(f"stored_{c}") for c in default.columns if c != key))
    joined = default.join(other, F.col(key) == F.col("stored_key"), "full_outer")
    return joined.select(F.coalesce(key, "stored_key").alias(key), *(F.coalesce(f"stored_{c}", c).alias(c) for c in default.columns if c != key))


def has_columns(df: DataFrame, *names: str) -> bool:
    """Whether a table has all of these columns."""
    return set(names) <= set(df.columns)


def missing_pages(expected: DataFrame, staged: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Pages of which a probe row isn't staged."""
    return expected.join(missing_keys(expected, staged, keys), keys, "left_semi").select(page).distinct()


def repaired(staged: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """staged, and the incoming rows whose key it lacks, one of each."""
    new = keep_one(incoming, keys, [F.col(order)], "collapse").join(staged.select(*keys), keys, "left_anti")
    return staged.unionByName(new.select(*staged.columns))


def rescanned(staged: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """staged and everything that a scan of all pages brings again, each key once: the first in order.

    Rows with a null key part can't be told apart from new ones and all stay.
    """
    return keep_one(staged.unionByName(incoming.select(*staged.columns)), keys, order)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV files with a header, all fields quoted.

    With mark, each file begins with a byte order mark, by which spreadsheet programs know UTF-8;
    only fields that need it are quoted then, as a quoted first header would stand before the mark.
    """
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, quoteAll=not mark)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_observed(df: DataFrame, path: str, measures: dict[str, Column]) -> dict[str, object]:
    """Writes df as Parquet under a new path and gives aggregates of what was written, from the same scan.

    The measures are taken where rows are written, in the job's last stage, so a task that runs again
    doesn't count twice.
    """
    seen = Observation()
    df.observe(seen, *(c.alias(name) for name, c in measures.items())).write.mode("errorifexists").parquet(path)
    return seen.get


def snapshot(df: DataFrame, path: str) -> None:
    """A Parquet copy under a new path; an old one is never overwritten."""
    df.write.mode("errorifexists").parquet(path)
