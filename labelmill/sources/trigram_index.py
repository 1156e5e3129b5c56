"""A stored trigram index of names: postings by gram, extended by appends.

Under its folder stand ``postings`` (a row for each gram of each name, in folders by append and by slot,
which is the gram's hash, sorted by gram), ``names`` and ``counts`` (in how many names each
gram stands). A search reads the slots of the rarest grams that a hit must have, and no other; a join
reads those that its rows ask for. An append is seen once its counts are there, which are written
last; one that is written again under its id takes its own place.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions import similarity as S
from labelmill.operators.search import SIMILAR, check_page
from labelmill.session import materialize

POSTING, NAME, COUNT = "gram string, key long, name string", "key long, name string", "gram string, n long"


class TrigramIndex:
    """Names by key in a folder. ``slots`` and the grams must be the same for all uses of it.

    A slot of an append should hold some 128 MB: postings take about ten times the names' bytes.
    """

    def __init__(self, spark: SparkSession, path: str, slots: int = 64, gram: Callable[[Column], Column] = S.word_trigrams) -> None:
        self.spark, self.path, self.slots, self.gram = spark, path.rstrip("/"), slots, gram

    def _slot(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.slots)).cast("int")

    def _read(self, part: str, schema: str, slotted: bool = False) -> DataFrame:
        folders = "append string" + ", slot int" * slotted
        return self.spark.read.schema(f"{schema}, {folders}").option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")

    def append(self, df: DataFrame, key: str, name: str, append_id: str) -> None:
        """Adds rows of new keys; null keys and names aren't searched for and stay out. A hot gram is written by several tasks."""
        rows = df.select(F.col(key).cast("long").alias("key"), F.col(name).cast("string").alias("name")).where("key IS NOT NULL AND name IS NOT NULL")
        rows.write.mode("overwrite").parquet(f"{self.path}/names/append={append_id}")
        rows = self.spark.read.schema(NAME).parquet(f"{self.path}/names/append={append_id}")
        grams = rows.select(F.explode(self.gram(F.col("name"))).alias("gram"), "key", "name").withColumn("slot", self._slot(F.col("gram")))
        spread = grams.repartition("slot", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("slot", "gram", "key")
        spread.write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/postings/append={append_id}")
        grams.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts/append={append_id}")

    def _seen(self) -> list[str]:
        """Ids of whole appends: a few, one for each."""
        return sorted(r[0] for r in self._read("counts", COUNT).select("append").distinct().collect())

    def _postings(self, grams: list[str]) -> DataFrame:
        """Postings of stated grams: filters on both kinds of folder, and on the sorted grams of their files."""
        slots = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(self._slot(F.col("g"))).distinct().collect()] if grams else []
        rows = self._read("postings", POSTING, True)
        return rows.where(F.col("append").isin(self._seen()) & F.col("slot").isin(slots) & F.col("gram").isin(grams)).select("key", "name")

    def _grams_of(self, q: str) -> tuple[list[str], list[str]]:
        """The grams of q, and those that a name must have that holds q anywhere, rare ones first."""
        # With a letter that q lacks put at either end, what is left of its grams are those inside it.
        end = next(c for c in map(chr, range(0x16A0, 0x16EA)) if c not in q)
        found = self.spark.range(1).select(self.gram(F.lit(q)), self.gram(F.lit(f"{end}{q}{end}"))).first()
        inside = [g for g in found[0] if g in found[1]]
        counts = {r.gram: r.n for r in self._read("counts", COUNT).where(F.col("gram").isin(sorted(set(found[0])))).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rare = lambda gs: sorted(set(gs), key=lambda g: (counts.get(g, 0), g))
        return rare(found[0]), rare(inside)

    def candidates(self, q: str) -> DataFrame:
        """(key, name) of all names that may be similar to q or hold it; of each at least once, and of others few."""
        grams, inside = self._grams_of(q)
        if not grams or not inside or any(c in q for c in "%_\\"):
            # Nothing that a hit must have: one or two letters, marks only, or live wildcards.
            return self._read("names", NAME).where(F.col("append").isin(self._seen())).select("key", "name")
        # Similar names share one of so many rarest grams; one that holds q has the rarest of its inner ones.
        n = len(grams) - ceil(len(grams) * SIMILAR - 1e-9) + 1
        return self._postings(sorted({*grams[:n], inside[0]})).distinct()

    def search(self, q: str, limit: int = 20, offset: int = 0) -> DataFrame:
        """(key, name, sim) as ``search.search`` gives it over all names."""
        check_page(q, limit, offset)
        rows = self.candidates(q).withColumn("sim", S.word_similarity(F.col("name"), F.lit(q)))
        hits = rows.where(F.ilike(F.col("name"), F.lit(f"%{q}%")) | (F.col("sim") >= SIMILAR))
        return hits.orderBy(F.col("sim").desc(), "name", "key").offset(offset).limit(limit)

    def similar(self, left: DataFrame, left_key: str, text: str, threshold: float) -> DataFrame:
        """(left_key, key, sim) of all pairs of a row of ``left`` and an indexed name that reach the threshold.

        Only ``left`` is cut to its rarest grams, by the stored counts; each is looked up in its slot.
        """
        grams = left.select(F.col(left_key).alias("l"), self.gram(F.col(text)).alias("lg")).where(F.size("lg") > 0)
        counts = materialize(self._read("counts", COUNT).groupBy("gram").agg(F.sum("n").alias("n")), "counts")
        each = grams.select("l", F.size("lg").alias("size"), F.explode("lg").alias("gram")).join(counts, "gram")
        ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("n", "gram")))
        # Grams that no name has are none of those counted: they come before all that are.
        held = ranked.withColumn("held", F.count("*").over(Window.partitionBy("l")))
        asked = held.where(F.col("r") + F.col("size") - F.col("held") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
        asked = asked.select("l", "gram", self._slot(F.col("gram")).alias("slot"))
        rows = self._read("postings", POSTING, True).where(F.col("append").isin(self._seen()))
        pairs = asked.join(rows, ["slot", "gram"]).select("l", "key", "name").distinct()
        scored = pairs.join(grams, "l").select(F.col("l").alias(left_key), "key", S.jaccard(F.col("lg"), self.gram(F.col("name"))).alias("sim"))
        return scored.where(F.col("sim") >= threshold)
