"""Stored tables that change by key: rows in folders by the hash of their key, and changes that write
only the folders they touch.

A change reads the touched folders, works out their new rows, writes those to the shared folder, and
puts them in place by dynamic partition overwrite, which Spark commits at the end of the job: a
lost executor costs a task, and a change done twice gives what it gives once. For that, incoming
rows with a null in their key aren't taken: nothing tells them from themselves. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators import dedup
from labelmill.session import materialize

SLOT = "key_slot"


class StoredTable:
    """A Parquet table under ``path`` with ``keys``; ``slots`` must stay what it was made with.

    A slot should hold some 128 MB or a few times that: it is what a change of one row rewrites.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], slots: int = 64) -> None:
        self.spark, self.path, self.keys, self.slots = spark, path.rstrip("/"), keys, slots

    def _slotted(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SLOT, F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(self.slots)).cast("int"))

    def _put(self, df: DataFrame, mode: str) -> None:
        rows = self._slotted(df).repartition(SLOT)
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(self.path)

    def create(self, df: DataFrame) -> None:
        """The first rows, one of each key; an old table is never overwritten."""
        self._put(df, "errorifexists")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(SLOT)

    def _change(self, incoming: DataFrame, change) -> list[int]:
        """Puts ``change(old rows, incoming)`` in place of the slots that incoming has rows for, and says which."""
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        incoming = materialize(self._slotted(incoming.where(known)), "incoming")
        # Slots are few, as the table's own number of folders bounds them.
        touched = sorted(r[0] for r in incoming.select(SLOT).distinct().collect())
        if touched:
            old = self.spark.read.parquet(self.path).where(F.col(SLOT).isin(touched)).drop(SLOT)
            self._put(materialize(change(old, incoming.drop(SLOT)), "changed"), "overwrite")
        return touched

    def upsert(self, incoming: DataFrame, order: list[Column]) -> list[int]:
        """Incoming rows in place of those of equal key, and besides; of several the first in order. Gives the slots written."""
        return self._change(incoming, lambda old, new: dedup.upsert(old, new, self.keys, order))

    def insert_if_absent(self, incoming: DataFrame, order: list[Column]) -> list[int]:
        return self._change(incoming, lambda old, new: dedup.insert_if_absent(old, new, self.keys, order))

    def patch(self, changes: DataFrame, columns: list[str], overwrite: bool = False, order: list[Column] | None = None) -> list[int]:
        """Columns filled from changes where null (or wherever changes has a value); keys that the table lacks add nothing. One key column."""
        (key,) = self.keys
        return self._change(changes, lambda old, new: dedup.patch(old, new, key, columns, overwrite, order))

    def land(self, stream: DataFrame, order: list[Column], checkpoint: str):
        """A stream's rows upserted batch by batch. A batch that runs again after a failure, or a stream begun again
        from its checkpoint, changes nothing that it has already changed: each key stays one row."""

        def put(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, order)

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
