"""The session for tests and benchmarks, and helpers that every module shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects: UTC, AQE and Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labelmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB in this session, so that a Python worker's memory stays small beside long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only on one machine, as in tests, a temporary folder is made where it is not set. A cluster
    must name one: its machines don't share such a folder, and rows would be lost.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="labelmill-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return (spark.sparkContext.getCheckpointDir() or made).rstrip("/")


#: Folders of the tables that ``materialize`` gave out and that are still there.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    The table stays until ``release`` takes it; what is left when a session has ended can be deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/labelmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` whose last reader is written; others are left alone."""
    for t in tables:
        path = _FOLDERS.pop(t, None)
        if path is not None:
            jvm = t.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
