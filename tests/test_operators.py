"""Properties and hand-worked cases of operators."""

import os
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelmill import session
from labelmill.functions import normalize, parse, similarity
from labelmill.operators import dedup, link, quality, rules, score
from labelmill.sources import landing
from labelmill.streaming import admission


def greedy(edges):
    used, out = set(), []
    for left in sorted({e[0] for e in edges}):
        free = [(-s, r) for a, r, s in edges if a == left and r not in used]
        if free:
            s, r = min(free)
            used.add(r)
            out.append((left, r))
    return sorted(out)


def test_exclusive_match_is_sequential_greedy(spark):
    rng = random.Random(3)
    for n in (1, 8, 30):
        edges = [(a, b, rng.randint(1, 5) / 5) for a in range(n) for b in range(n) if rng.random() < 0.3]
        got = link.exclusive_match(spark.createDataFrame(edges or [(0, 0, 1.0)], "l long, r long, s double"), "l", "r", "s")
        assert sorted((x.l, x.r) for x in got.collect()) == greedy(edges or [(0, 0, 1.0)])


def test_trigram_join_equals_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))).strip() for _ in range(60)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, None)], "k long, t string")
    left, right = df.withColumnRenamed("k", "a"), df.withColumnRenamed("k", "b")
    both = left.join(right.withColumnRenamed("t", "u"), F.col("a") >= 0).withColumn("sim", similarity.similarity(F.col("t"), F.col("u")))
    for threshold in (0.3, 0.6, 1.0):
        want = {(r.a, r.b) for r in both.where(F.col("sim") >= threshold).collect()}
        assert {(r.a, r.b) for r in link.trigram_join(left, right, "a", "b", "t", threshold).collect()} == want


def test_similarity_is_symmetric_and_one_on_itself(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", "x"), (None, "x"), ("한글", "한글"), ("a", "a b")], "a string, b string")
    for r in rows.select("a", "b", similarity.similarity(F.col("a"), F.col("b")).alias("x"), similarity.similarity(F.col("b"), F.col("a")).alias("y"), similarity.similarity(F.col("b"), F.col("b")).alias("z")).collect():
        assert r.x == r.y and 0 <= r.x <= 1 and r.z == 1


def test_colour_never_improves_with_the_amount(spark):
    df = spark.range(0, 3000, 25).select(F.col("id").cast("double").alias("sodium"), F.lit(50.0).alias("serving_size"), F.lit("과자").alias("food_type"), F.lit("g").alias("content_unit"), F.lit("칩").alias("product_name"), F.lit(200.0).alias("total_content"))
    none = F.lit(None).cast("double")
    df = df.withColumns({n: none for n in ("calories", "sugars", "sat_fat", "total_fat", "cholesterol", "protein", "fiber", "trans_fat")})
    ranks = [r[0] for r in score.evaluate(df).orderBy("sodium").select(score.color_rank(F.col("sodium_color"))).collect()]
    assert ranks == sorted(ranks) and set(ranks) == {1, 2, 4}


def test_dedup_is_idempotent_and_modes_differ_on_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, k string")
    latest = dedup.keep_latest(df, ["k"], "id")
    assert sorted(r.id for r in latest.collect()) == [2, 3, 4, 5]
    assert sorted(r.id for r in dedup.keep_latest(latest, ["k"], "id").collect()) == [2, 3, 4, 5]
    assert sorted(r.id for r in dedup.keep_earliest(df, ["k"], "id").collect()) == [1, 3, 5]


@settings(max_examples=200, deadline=None)
@given(st.text("ab(),[]{} %1산", max_size=40))
def test_parsers_never_fail_and_keep_top_items(text):
    items = parse.label_items(text)
    assert all(i["raw"] and isinstance(i["sub_ingredients"], list) for i in items)
    assert all(isinstance(i["name"], str) for i in parse.ingredient_tree(text))


def test_tree_of_odd_lists():
    sub = lambda *names: [{"name": n, "percentage": p} for n, p in names]
    cases = {
        "(구연산), 혼합제제【비타민C, (탄산칼슘)】 5%": [("구연산)", "", []), ("혼합제제", "비타민C, (탄산칼슘)", sub(("비타민C", None), ("(탄산칼슘)", None))), ("5%", "", [])],
        "분유[알레르기 유발물질: 우유], 소금": [("분유", "", []), ("소금", "", [])],
        "A{b 5%, c 2,5 %} *대두 함유* , 설탕": [("A", "b 5%, c 2,5 %", sub(("b", 5.0), ("c 2", None), ("", 5.0))), ("설탕", "", [])],
        "A(b, c(d, e)) x": [("A", "b, c(d, e)", sub(("b", None), ("c(d", None), ("e)", None))), ("x", "", [])],
        "A(b 5%, c": [("A", "b 5%, c", sub(("b 5%", None), ("c", None)))],
        "A(": [],
        "A[b, c], )d": [("A[b", "", []), ("c]", "", []), (")d", "", [])],
        " , ,": [],
    }
    for text, want in cases.items():
        assert [(x["name"], x["raw"], x["sub_ingredients"]) for x in parse.ingredient_tree(text)] == want, text


def test_names_as_the_reference_makes_them(spark):
    rows = ["미니 파우치 개성주악 3개입", "달콤（사과）【특】{a}", "콜라 355ml 12.5", "A팩B (행사) 2OZ can", "봉지라면 묶음 5", "a-b_c×d*e+f&g/h"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = df.select("k", normalize.product_name(F.col("t")), normalize.deep(F.col("t")), normalize.deep_words(F.col("t"))).orderBy("k").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("미니파우치개성주악3개입", "개성주악3개입", "미니파우치개성주악3개입"),
        ("달콤사과특{a}", "달콤사과특{a}", "달콤{a}"),
        ("콜라355ml12.5", "콜라12.", "콜라"),
        ("a팩b행사2ozcan", "abcan", "ab"),
        ("봉지라면묶음5", "라면", "봉지라면묶음"),
        ("abc×d*e+f&g/h", "abcdefgh", "abcdefgh"),
    ]


def test_maker_parity_switch(spark):
    r = spark.createDataFrame([("(주)주주식품",)], "c string").select(normalize.maker(F.col("c")).alias("a"), normalize.maker(F.col("c"), parity=True).alias("b")).first()
    assert (r.a, r.b) == ("주주식품", "식품")


def test_dictionary_beyond_the_bound_gives_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "red apple pie"), (2, "green"), (3, None), (4, ""), (5, "설탕 소금, 굴과 밀"), (5, "밀"), (6, "ab")], "k long, t string")
    words = spark.createDataFrame([("apple",), ("green",), ("gre",), ("zzz",), ("밀",), ("소금",), ("굴",), ("설탕 소금",), ("ab",), ("b",), ("",), (None,), ("밀",)], "w string")
    want = {(1, "apple"), (2, "green"), (2, "gre"), (5, "밀"), (5, "소금"), (5, "굴"), (5, "설탕 소금"), (6, "ab"), (6, "b")}
    for bound in (link.AUTOMATON_BYTES, -1):
        monkeypatch.setattr(link, "AUTOMATON_BYTES", bound)
        got = link.dictionary_hits(texts, words, "k", "t", "w").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) + 1
        assert link.dictionary_hits(texts, words.limit(0), "k", "t", "w").count() == 0


def test_events_with_one_id_stay_as_many_as_they_were(spark):
    rows = [("u", "2024-01-01 00:00:00", 1), ("u", "2024-01-01 12:00:00", 1), ("u", "2024-01-02 00:00:00", 1), ("v", None, 1), (None, "2024-01-01 00:00:00", 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "k string, at string, o int, c0 int")
    got = admission.accepted_first(df, ["k"], "at", "o")
    assert got.columns == [*df.columns, "accepted"]
    assert sorted((r.k or "", r.at or "", r.accepted) for r in got.collect()) == [("", "2024-01-01 00:00:00", True), ("u", "2024-01-01 00:00:00", True), ("u", "2024-01-01 12:00:00", False), ("u", "2024-01-02 00:00:00", True), ("v", "", False)]


def test_long_labels_are_read_whole(spark):
    from labelmill.operators import labels

    text = "x " * 8000 + "나트륨 200 mg"
    row = spark.createDataFrame([(text, 0.9, "n", "과자", "g", None)], "text string, confidence double, product_name string, food_type string, content_unit string, total_content double")
    assert labels.analyze_labels(row, []).first().sodium == 200.0
    assert labels.analyze_labels(row, [], most_characters=10_000).first().sodium is None


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from labelmill import session

    away = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k, d: d), getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.shared_dir(away)


def test_landing_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, " a "), (2, "  ")], "id long, name string")
    staged = landing.stage(df, {"nm": "name"})
    assert [(r.nm, r.raw_data) for r in staged.orderBy("raw_data").collect()] == [("a", '{"id":1,"name":" a "}'), (None, '{"id":2,"name":"  "}')]
    landing.write_csv(df, str(tmp_path / "csv"))
    landing.write_json(df, str(tmp_path / "json"))
    landing.snapshot(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    assert landing.has_columns(df, "id") and not landing.has_columns(df, "x")
    expected = spark.createDataFrame([(1, "k1"), (2, "k2")], "page long, k string")
    assert [r.page for r in landing.missing_pages(expected, spark.createDataFrame([("k1",)], "k string"), ["k"], "page").collect()] == [2]


def test_csv_with_a_mark_and_a_full_scan_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "한, \"x\""), (2, None)], "id long, name string")
    landing.write_csv(df.coalesce(1), str(tmp_path / "csv"), mark=True)
    (file,) = (tmp_path / "csv").glob("part-*")
    assert file.read_bytes().startswith("\ufeffid,name\n".encode())
    landing.write_csv(df, str(tmp_path / "plain"))
    assert all(f.read_bytes().startswith(b'"id","name"\n') for f in (tmp_path / "plain").glob("part-*"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, schema="id long, name string", escape="\\")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    old = spark.createDataFrame([(1, "a"), (None, "b")], "id long, name string")
    again = landing.rescanned(old, spark.createDataFrame([("c", 1, 0), ("c", 3, 0), ("c", 3, 0), ("b", None, 0)], "name string, id long, more int"), ["id"], [F.col("name").desc()])
    assert sorted(map(str, again.collect())) == sorted(map(str, spark.createDataFrame([(1, "c"), (3, "c"), (None, "b"), (None, "b")], "id long, name string").collect()))


def test_text_card(spark):
    nothing = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("sugars", "sat_fat", "total_fat", "cholesterol", "protein", "fiber"))
    df = spark.sql(f"SELECT '면' AS product_name, '라면' AS food_type, 'g' AS content_unit, 100D AS serving_size, 100D AS total_content, 450.5D AS calories, 900D AS sodium, 0D AS trans_fat, {nothing}")
    out = score.evaluate(df)
    facts = {n: F.col(n) for n in ("sodium", "trans_fat")}
    card = out.select(score.text_card(score.sanity_warnings(F.col("serving_size"), facts)).alias("c")).first().c.split("\n")
    assert card[0] == "┌─── 면 ───" and "│  열량      450.5kcal   22.5%" in card and card[-1] == "└" + "─" * 23
    assert any(line.startswith("│  나트륨　　　  🔴 45%") for line in card) and "│  당류　　　　  데이터 없음" in card and "│  트랜스지방　  🟢   [absolute]" in card
    beer = score.evaluate(df.withColumn("food_type", F.lit("맥주"))).select(score.text_card().alias("c")).first().c
    assert beer == "⛔ 면: 주류는 영양 신호등 평가 대상이 아닙니다."


def _stream(spark, tmp_path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    one = spark.createDataFrame(rows[0], schema)
    return spark.readStream.schema(one.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_verification_stream_equals_batch(spark, tmp_path):
    rows = [[(1, "2024-01-01 00:00:00", 1, 0.5)], [(1, "2024-01-02 00:00:00", 2, 0.95), (2, "2024-01-02 00:00:00", 3, 0.99)], [(1, "2024-01-03 00:00:00", 4, 0.1)]]
    schema = "k long, at string, o long, c double"
    stream = admission.verification_stream(_stream(spark, tmp_path, rows, schema), "k", "c")
    stream.writeStream.format("memory").queryName("verified").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    last = {r.key: (r.status, r.verify_count) for r in spark.table("verified").orderBy("verify_count").collect()}
    batch = admission.verification(spark.createDataFrame(sum(rows, []), schema), "k", "at", "o", F.col("c"))
    assert last == {r.k: (r.status, r.verify_count) for r in batch.collect()} == {1: ("verified", 3), 2: ("partial", 1)}


def test_threshold_table(spark):
    assert rules.threshold_table(spark).count() == 5 + 4 + 4 + 2


def test_entry_point_without_the_training_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_has", lambda name: False)
    assert not any(n.startswith("op") for n in entry.queries()) and set(entry.oracle_sql()) < set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_exclusive_query_takes_every_supplier(spark, tmp_path):
    from labelmill.plans import QUERIES

    suppliers, nations = [*range(60, 75), 1000, 1001], range(25)
    spark.createDataFrame([(k,) for k in suppliers], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k,) for k in nations], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    edges = [(s, n, 1.0 - abs(s % 25 - n) / 25.0) for s in suppliers for n in nations if abs(s % 25 - n) <= 2]
    got = QUERIES["match_exclusive_greedy"](spark, str(tmp_path)).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == greedy(edges) != []


def test_windows_by_stretches_equal_windows_by_key(spark):
    from pyspark.sql import Window

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), f"2024-01-0{rng.randint(1, 6)} {rng.randint(0, 23):02}:00:00" if rng.random() < 0.9 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, at string, o int")
    day = 24 * 3600
    t, micros = F.unix_micros(F.col("at").cast("timestamp")), day * 1_000_000
    before = F.lag(t).over(Window.partitionBy("k").orderBy("at", "o"))
    want = df.withColumn("is_repeat", F.coalesce(t - before < micros, F.lit(False)))
    got = admission.follows_within(df, ["k"], "at", "o")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    w = Window.partitionBy("k").orderBy(t).rangeBetween(1 - micros, 0)
    counts = df.withColumn("n_reports", F.count("*").over(w)).withColumn("disputed", F.col("n_reports") >= 3)
    got = admission.reports_in(df, "k", "at", day)
    assert got.columns == counts.columns and sorted(map(str, got.collect())) == sorted(map(str, counts.collect()))


def test_verification_follows_the_order(spark):
    cases = {"none": [(1, 0.5), (2, None)], "last": [(1, 0.5), (2, 0.95)], "first": [(1, 0.95), (2, None)], "one": [(1, 0.9)], "twice": [(1, 0.95), (1, 0.95)]}
    df = spark.createDataFrame([(k, f"2024-01-0{d} 00:00:00", d, c) for k, some in cases.items() for d, c in some], "k string, at string, o int, c double")
    got = {r.k: (r.status, r.verify_count) for r in admission.verification(df, "k", "at", "o", F.col("c")).collect()}
    assert got == {"none": ("unverified", 2), "last": ("partial", 2), "first": ("verified", 2), "one": ("partial", 1), "twice": ("verified", 2)}


def test_measures_come_with_the_write(spark, tmp_path):
    rows = [("matched", 1), ("matched", None), ("pooled", 3), (None, 4), ("odd", None)]
    df = spark.createDataFrame(rows, "status string, v int").repartition(3)
    measures = quality.status_measures("status", ("matched", "rejected", "pooled")) | quality.null_measures(["v"])
    told = landing.write_observed(df, f"{tmp_path}/log", measures)
    assert told == {"total": 5, "matched": 2, "matched_rate": 40.0, "rejected": 0, "rejected_rate": 0.0, "pooled": 1, "pooled_rate": 20.0, "other": 2, "other_rate": 40.0, "v": 40.0}
    assert told == df.agg(*(c.alias(k) for k, c in measures.items())).first().asDict()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 5


def test_a_large_dictionary_costs_what_a_small_one_does(spark):
    words = [("", "blank"), ("소금", "salt"), ("금", "metal"), ("소금", "mineral"), ("산", "acid")]
    label = "정제소금(구연산, 소금물), 소금, 금산"
    names = lambda d: [(x["name"], x["category"], x["match_type"]) for x in parse.additives_of(parse.label_items(label), parse.Dictionary(d))]
    assert names(words) == [("소금", "mineral", "partial(main)"), ("금", "metal", "partial(sub)"), ("산", "acid", "detail_scan")]
    large = words + [(f"없는말{k}", "x") for k in range(10_000)]
    assert names(large) == names(words)
    items, seconds = parse.label_items(label), []
    for d in (words, large):
        made = parse.Dictionary(d)
        began = time.perf_counter()
        for _ in range(300):
            parse.additives_of(items, made)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 3 * seconds[0] + 0.05
    rows = spark.createDataFrame([(1, label), (2, None), (3, "")], "id int, t string")
    got = rows.select("id", parse.read_labels(large)(F.col("t")).alias("r")).orderBy("id").collect()
    assert [len(r.r["items"]) for r in got] == [3, 0, 0] and [a.name for a in got[0].r.additives] == [x[0] for x in names(words)]


def test_tables_go_when_they_are_released(spark):
    made, kept = (session.materialize(spark.range(5), name) for name in ("made", "kept"))
    folder = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder) and made.count() == 5
    session.release(made, spark.range(3), made)
    assert not os.path.exists(folder) and kept.count() == 5


def test_status_and_counter_after_submissions_in_order(spark):
    """Against the update that is made for each submission in turn."""
    rng = random.Random(11)
    products = [(k, rng.choice(["unverified", "partial", "verified", "disputed", "admin_verified", None]), rng.choice([0, 1, 2, None])) for k in range(60)]
    submissions = [(rng.randint(0, 70), rng.randint(0, 5), k, rng.choice([0.5, 0.9, 0.95, None])) for k in range(120)]
    want = []
    for k, status, count in products:
        for _, _, _, sure in sorted((s for s in submissions if s[0] == k), key=lambda s: s[1:3]):
            if status == "unverified":
                status = "partial" if sure is not None and sure >= 0.9 else "unverified"
            elif status == "partial" and count is not None and count >= 1:
                status = "verified"
            count = None if count is None else count + 1
        want.append((k, status, count))
    df = spark.createDataFrame(products, "k int, verification string, verify_count int")
    got = admission.advance(df, spark.createDataFrame(submissions, "k int, at int, o int, c double"), "k", "at", "o", F.col("c"))
    assert got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_seaweed_is_dried_for_the_scorer_and_not_for_reports(spark):
    """The reports' own copy of the category rules knows no seaweed; all else is the same."""
    rows = [("기타", "g", "구운 김", "dried", "general"), ("기타", "g", "김밥", "general", "general"), ("기타", "g", "배추김치", "fermented", "fermented"), ("기타", "ml", "김", "beverage", "beverage"), (None, None, None, "general", "general"), ("맥주", "ml", "김", "alcohol", "alcohol")]
    df = spark.createDataFrame(rows, "t string, u string, n string, own string, report string")
    of = [F.col(c) for c in "tun"]
    for r in df.select("*", score.food_category(*of).alias("a"), score.food_category(*of, seaweed=False).alias("b")).collect():
        assert (r.a, r.b) == (r.own, r.report)
