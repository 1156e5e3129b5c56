"""Stored tables and the stored trigram index: only what changes is written, only what is asked for is read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from labelmill.functions import similarity
from labelmill.operators import dedup, link, search
from labelmill.sources.stored import StoredTable
from labelmill.sources.trigram_index import TrigramIndex
from tests.test_queries import DATA


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def suppliers(spark):
    return spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_name", "p_size")


def test_upsert_writes_only_the_slots_it_touches(spark, suppliers, tmp_path):
    stored = StoredTable(spark, f"{tmp_path}/t", ["p_partkey"], slots=16)
    stored.create(suppliers)
    before = files(stored.path)
    incoming = spark.createDataFrame([(3, "b", 1), (3, "a", 2), (5_000, "new", 3), (None, "lost", 4)], "p_partkey long, p_name string, p_size int")
    touched = stored.upsert(incoming, [F.col("p_name")])
    known = incoming.where("p_partkey IS NOT NULL")
    want = rows(dedup.upsert(suppliers, known, ["p_partkey"], [F.col("p_name")]))
    assert rows(stored.read().select(suppliers.columns)) == want and 1 <= len(touched) <= 2
    stays = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert len(stays) >= 14 and stays <= files(stored.path) and not (before - stays) & files(stored.path)
    # Once more, as after a failure, nothing changes.
    stored.upsert(incoming, [F.col("p_name")])
    assert rows(stored.read().select(suppliers.columns)) == want


def test_insert_and_patch(spark, suppliers, tmp_path):
    stored = StoredTable(spark, f"{tmp_path}/t", ["p_partkey"], slots=8)
    some = suppliers.where("p_partkey % 2 = 0").withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")))
    stored.create(some)
    stored.insert_if_absent(suppliers.where("p_partkey < 20"), [F.col("p_name")])
    want = dedup.insert_if_absent(some, suppliers.where("p_partkey < 20"), ["p_partkey"], [F.col("p_name")])
    assert rows(stored.read().select(suppliers.columns)) == rows(want)
    changes = spark.createDataFrame([(2, 70), (2, 60), (4, 80), (9_999, 1), (6, None)], "p_partkey long, p_size int")
    stored.patch(changes, ["p_size"])
    got = {r.p_partkey: r.p_size for r in stored.read().collect()}
    assert got[2] == 60 and got[4] == some.where("p_partkey = 4").first().p_size and got[6] is None and 9_999 not in got
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        stored.create(some)


def test_patch_takes_one_change_of_a_key(spark):
    target = spark.createDataFrame([(1, None, "x"), (2, 5, None), (None, None, None)], "k int, a int, b string")
    changes = spark.createDataFrame([(1, 9, None), (1, 3, "z"), (2, 7, "y"), (None, 8, "q")], "k int, a int, b string")
    assert rows(dedup.patch(target, changes, "k", ["a", "b"])) == rows(spark.createDataFrame([(1, 3, "x"), (2, 5, "y"), (None, None, None)], target.schema))
    assert rows(dedup.patch(target, changes, "k", ["a"], overwrite=True, order=[F.col("a").desc()])) == rows(spark.createDataFrame([(1, 9, "x"), (2, 7, None), (None, None, None)], target.schema))


def test_landing_a_stream_twice_leaves_one_row_of_each_key(spark, suppliers, tmp_path):
    stored = StoredTable(spark, f"{tmp_path}/t", ["p_partkey"], slots=4)
    stored.create(suppliers.where("p_partkey < 10"))

    def put(k, df):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema(suppliers.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        made = stored.land(stream, [F.col("p_name")], f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert made.awaitTermination(200) and made.exception() is None

    put(0, suppliers.where("p_partkey BETWEEN 5 AND 60"))
    run()
    # The commit of the batch is lost, so it comes again with the next ones.
    for name in os.listdir(f"{tmp_path}/cp/commits"):
        os.remove(f"{tmp_path}/cp/commits/{name}")
    put(1, suppliers.where("p_partkey BETWEEN 50 AND 99").withColumn("p_name", F.concat(F.col("p_name"), F.lit(" anew"))))
    run()
    run()
    got = {r.p_partkey: r.p_name for r in stored.read().collect()}
    assert stored.read().count() == len(got) == suppliers.where("p_partkey <= 99").count()
    assert got[70].endswith(" anew") and not got[45].endswith(" anew")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = TrigramIndex(spark, str(tmp_path_factory.mktemp("index")), slots=8)
    names = ["cold ring", "Cold Rings", "xcold ringx", "ring", "cold", "co", "-- ", "", None, "100% cold", "a_b", "ring of cold", "콜라 제로", "콜라"]
    words = "small red blue hot old cold ring bolt gear gizmo widget".split()
    rng = random.Random(3)
    names += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(120)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)] + [(None, "cold ring")], "id int, name string")
    made.append(df.where("id % 2 = 0 OR id IS NULL"), "id", "name", "a")
    return made, df


QUERIES = ["cold ring", "old", "rin", "COLD", "co", "r", "--", "0% c", "a_b", "ring cold", "d r", "콜라", "no such thing"]


@pytest.mark.parametrize("q", QUERIES)
def test_search_by_the_index_is_the_search_over_all_names(index, q):
    made, df = index
    known = df.where("id % 2 = 0")
    want = search.search(known, "name", q, 50, 0, "id").collect()
    assert [(r.key, r.name, r.sim) for r in made.search(q, 50).collect()] == [(r.id, r.name, r.sim) for r in want]
    assert [r.key for r in made.search(q, 3, 2).collect()] == [r.id for r in want[2:5]]


def test_search_after_an_append_and_what_it_reads(spark, index, tmp_path):
    made, df = index
    more = TrigramIndex(spark, str(tmp_path), slots=8)
    more.append(df.where("id % 2 = 0"), "id", "name", "a")
    more.append(df.where("id % 2 = 1"), "id", "name", "b")
    more.append(df.where("id % 2 = 1"), "id", "name", "b")
    # One that isn't whole isn't seen.
    os.makedirs(f"{tmp_path}/names/append=c")
    df.select(F.col("id").cast("long").alias("key"), "name").write.mode("overwrite").parquet(f"{tmp_path}/names/append=c")
    for q in QUERIES:
        want = search.search(df.where("id IS NOT NULL"), "name", q, 50, 0, "id").collect()
        assert [(r.key, r.name) for r in more.search(q, 50).collect()] == [(r.id, r.name) for r in want]
    plan = more.candidates("cold ring")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan
    assert more.candidates("no such thing").count() < df.count() / 4
    pairs = more.similar(df.where("id < 40 AND name != ''").select("id", "name"), "id", "name", 0.5)
    left = df.where("id < 40").select(F.col("id").alias("a"), "name")
    want = link.trigram_join(left, df.where("id IS NOT NULL").select(F.col("id").alias("b"), "name"), "a", "b", "name", 0.5, gram=similarity.word_trigrams)
    assert rows(pairs.select(F.col("id").cast("int"), F.col("key").cast("int"), "sim")) == rows(want)


def test_top_k_join_finds_the_best_of_all_pairs_and_tries_fewer(spark):
    rng = random.Random(12)
    words = "amber brook cedar delta ember fjord grove haven islet jetty".split()
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(400)})
    df = spark.createDataFrame([(k, n, k % 2) for k, n in enumerate(names)], "k int, t string, g int")
    left, right = df.select(F.col("k").alias("a"), "t", "g"), df.select(F.col("k").alias("b"), "t", "g")
    for block in (None, "g"):
        counted, today = [], []
        got = link.top_k_join(left, right, "a", "b", "t", 3, 0.3, block=block, at_once=0, counted=counted)
        once = link.top_k_join(left, right, "a", "b", "t", 3, 0.3, block=block, counted=today)
        assert len(counted) >= 2 and len(today) == 1 and rows(once) == rows(got)
        pairs = link.trigram_join(left, right, "a", "b", "t", 0.3, block=block)
        want = dedup.first_per_group(pairs, ["a"], [F.col("sim").desc(), F.col("b")], 3).drop("rank")
        assert rows(got.select("a", "b", "sim")) == rows(want.select("a", "b", "sim"))
        # Names here have few partners or many: those that have many are done before the lowest threshold.
        assert counted[-1] < today[0] and sum(counted) < 1.3 * today[0]
