import itertools
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from labelmill.llm import neardedup
from labelmill.llm.components import connected_components
from tests.llm.common import documents, empty, lower, same_rows, space_words


def brute(rows):
    sets = defaultdict(set)
    for doc_id, text in rows:
        words = space_words(lower(text or ""))
        if doc_id is not None:
            sets[doc_id] |= {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_against_all_pairs(spark):
    docs = documents(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = neardedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_one_of_each_keeps_columns_and_clean_documents(spark):
    docs = documents(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    kept = neardedup.one_of_each(docs)
    assert kept.columns == docs.columns
    same_rows(kept.collect(), [r for r in docs.collect() if r.doc_id is None or want[r.doc_id][1] == r.doc_id])


def test_chain_of_versions_needs_more_than_one_hub(spark):
    """Each version is near the next one only; a bucket's hub links few of them."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
    versions = []
    for k in range(40):
        versions.append((k * 7 % 40, " ".join(words)))
        for at in rng.integers(0, 300, 4):
            words[at] = f"v{rng.integers(0, 10**6)}"
    docs = spark.createDataFrame(versions, "doc_id long, text string")
    want = brute(versions)
    assert len({c for _, c in want.values()}) < 40
    same_rows([(r.doc_id, r.n_shingles, r.component_id) for r in neardedup.near_duplicates(docs).collect()], [(d, *v) for d, v in want.items()])


def test_sketch_limit_passes_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in (8, 70, 700, 7000, 70000):
        for _ in range(6):
            items = rng.integers(0, 2**63, n * 8 // 7, dtype=np.int64).astype(np.uint64)
            shared, rest = items[: n * 6 // 7], items[n * 6 // 7 :]
            sets = [np.unique(np.append(shared, r)) for r in np.array_split(rest, 2)]
            sketches = neardedup.odd_sketches(sets).view(np.int64)
            rows.append((sketches[0].tolist(), sketches[1].tolist(), len(sets[0]), len(sets[1])))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>, n_a long, n_b long")
    assert frame.where(neardedup.alike("a", "b", "n_a", "n_b", 75)).count() == len(rows)


def test_empty_table(spark):
    assert neardedup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 60), (60, 70), (5, 5), (None, 3), (1, 0), (200, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {60: 60, 70: 60, 100: 60, 200: 200, 300: 200}


def shuffled_records(spark):
    """Records that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_what_no_join_needs_is_not_shuffled(spark):
    """Of documents without copies each band key moves once, to be counted, also where Spark broadcasts nothing."""
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))) for k in range(300)]
    docs = spark.createDataFrame([*rows, (300, rows[0][1] + " more")], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_records(spark)
        got = {r.doc_id: r.component_id for r in neardedup.near_duplicates(docs).collect()}
        moved = sum(n for k, n in shuffled_records(spark).items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {k: k % 300 for k in range(301)}
    assert 32 * 301 <= moved <= 1.5 * 32 * 301


def shuffled_bytes(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_signatures_of_single_documents_stay_in_the_scan(spark):
    """Of documents without copies no samples or sketches move, and of each band key only what tells it from others."""
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))) for k in range(600)]
    docs = spark.createDataFrame([*rows, (600, rows[0][1]), (601, rows[1][1] + " more")], "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = {r.doc_id: r.component_id for r in neardedup.near_duplicates(docs).collect()}
        moved = sum(n for k, n in shuffled_bytes(spark).items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {k: k % 600 for k in range(602)}
    # A key takes 10 to 12 bytes with its frame; a document's samples and sketch take some 500 more.
    assert moved <= 16 * 32 * 602


def test_left_pairs_against_all_pairs(spark):
    """Large buckets in several blocks, buckets that share pairs, and groups that go over Arrow batches."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.append(base[rng.integers(0, 60 if k % 3 else 30) :], rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.int64).astype(np.uint64))) for k in range(700)]
    sketches = neardedup.odd_sketches(sets).view(np.int64)
    frame = spark.createDataFrame([(k, sketches[k].tolist(), len(sets[k])) for k in range(700)], "rep long, sketch array<long>, n long")
    buckets = {5: range(600), -3: range(590, 640), 9: range(0, 700, 7), 2: (650, 651), 1: (660, 661)}
    rows = [(key, k, k % 40 if key != 1 else 660, len(members)) for key, members in buckets.items() for k in members]
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = [tuple(r) for r in neardedup.left_pairs(spark.createDataFrame(rows, "key long, rep long, component long, size long"), frame, 75).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    own = defaultdict(dict)
    for key, k, component, _ in rows:
        own[key][k] = component
    meet = {(a, b) for members in own.values() for a, b in itertools.combinations(sorted(members), 2) if members[a] != members[b]}
    a, b = frame.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), frame.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    near = {tuple(r) for r in a.join(b, F.col("a") < F.col("b")).where(neardedup.alike("sa", "sb", "na", "nb", 75)).select("a", "b").collect()}
    assert len(meet) > len(meet & near) > 1000
    assert sorted(got) == sorted(meet & near)
