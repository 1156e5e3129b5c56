"""Linkage over all parts, which has no SQL, against plain loops over all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelmill.functions import extract, normalize
from labelmill.functions import similarity as S
from labelmill.operators import dedup, enrich, link, matching
from labelmill.plans import QUERIES
from labelmill.plans.scoring import _both_sides
from tests.test_operators import greedy
from tests.test_queries import DATA


def grams(text, words=False):
    parts = re.findall(r"[^\W_]+", text.lower()) if words else [text] if text else []
    return {f"  {p} "[i : i + 3] for p in parts for i in range(len(p) + 1)}


def alike(a, b, words=False):
    x, y = grams(a, words), grams(b, words)
    return len(x & y) / len(x | y) if x and y else 0.0


def same(a, b):
    return bool(a and b) and (a in b or b in a)


def sides(spark, **forms):
    """Rows of both sides with normal forms, which other tests hold against SQL."""
    return [[r.asDict() for r in df.select("id", "name", "maker", *(f(F.col("name") if "name" in k else F.col("maker")).alias(k) for k, f in forms.items())).collect()] for df in _both_sides(spark, DATA)]


def distinct(rows, *keys):
    """The smallest id of each combination of values."""
    found = {}
    for r in rows:
        k = tuple(r[x] for x in keys)
        found[k] = min(r["id"], found.get(k, r["id"]))
    return [r for r in rows if found[tuple(r[x] for x in keys)] == r["id"]]


def test_exclusive_merge(spark):
    left, right = (distinct(rows, "name", "maker") for rows in sides(spark, name_form=normalize.name, simple_maker=normalize.manufacturer, name_volume=extract.volume))
    edges = []
    for a in left:
        for b in right:
            makers = alike(a["simple_maker"], b["simple_maker"])
            other = None not in (a["name_volume"], b["name_volume"]) and a["name_volume"] != b["name_volume"]
            if not other and not (len(a["simple_maker"]) > 1 < len(b["simple_maker"]) and makers < 0.3):
                score = alike(a["name_form"], b["name_form"]) * 0.7 + makers * 0.3
                if score >= 0.8:
                    edges.append((a["id"], b["id"], score))
    got = QUERIES["merge_parts_all"](spark, DATA).collect()
    want = greedy(edges)
    assert sorted((r.left_id, r.right_id) for r in got if r.part == "matched") == want and len(want) > 100
    assert {r.left_id for r in got if r.part == "left_only"} == {a["id"] for a in left} - {x for x, _ in want}
    assert {r.right_id for r in got if r.part == "right_only"} == {b["id"] for b in right} - {y for _, y in want}


def test_fuzzy_decisions(spark):
    forms = {"name_form": normalize.product_name, "maker_form": normalize.strip_corporate, "name_unit": extract.unit_family}
    products, facts = (distinct(rows, "name", "name_form", "maker_form") for rows in sides(spark, **forms))
    edges, rejected = [], set()
    for f in facts:
        some = []
        for p in products:
            if len(f["maker_form"]) <= 1 or f["maker_form"] == p["maker_form"]:
                sim = alike(f["name_form"], p["name_form"])
                if sim >= (0.8 if len(f["name_form"]) <= 5 else 0.7):
                    some.append((-sim, p["id"], p["name_unit"]))
        for sim, key, unit in sorted(some)[:3]:
            if None not in (unit, f["name_unit"]) and unit != f["name_unit"]:
                rejected.add((f["id"], key))
            else:
                edges.append((f["id"], key, -sim))
    got = QUERIES["fuzzy_decisions_all"](spark, DATA).collect()
    want = greedy(edges)
    assert sorted((r.fact_id, r.product_id) for r in got if r.status == "matched") == want and len(want) > 100
    assert {(r.fact_id, r.product_id) for r in got if r.status == "rejected"} == rejected
    assert {r.fact_id for r in got if r.status == "pooled"} == {f["id"] for f in facts} - {x for x, _ in want}


def test_fact_passes(spark):
    products, facts = sides(spark, name_deep=normalize.deep, maker_key=normalize.maker, name_unit=extract.unit_family)
    facts = distinct(facts, "name", "maker")
    official = {r.p_partkey: r.n for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", normalize.deep(F.concat_ws(" ", "p_name", "p_type")).alias("n")).collect()}
    want = []
    for p in products:
        for number, text, block, most in ((1, p["name_deep"], True, 3), (2, official[p["id"]], True, 3), (3, p["name_deep"], False, 1)):
            if not text or number == 2 and text == p["name_deep"]:
                continue
            least = 0.85 if not block else 0.8 if len(text) <= 5 else 0.7
            some = sorted((-alike(text, f["name_deep"]), f["id"], f["name_unit"]) for f in facts if not block or p["maker_key"] == f["maker_key"] != "")
            some = [x for x in some if -x[0] >= least][:most]
            keep = [x for x in some if None in (x[2], p["name_unit"]) or x[2] == p["name_unit"]]
            if keep:
                want.append((p["id"], keep[0][1], number))
                break
    got = QUERIES["match_facts_all"](spark, DATA).collect()
    assert sorted((r.product_id, r.fact_id, r.pass_no) for r in got) == sorted(want) and len(want) > 100


def test_ingredient_passes(spark):
    products, staged = sides(spark, maker_key=normalize.maker)
    staged = [s | {"no": str(s["id"]), "name": s["name"].strip(" ")} for s in distinct(staged, "name", "maker")]
    want = []
    for p in products:
        name = p["name"].strip(" ")
        inside = sorted((len(s["name"]), s["name"], s["no"], s["maker_key"]) for s in staged if len(name) >= 3 and name in s["name"])[:10]
        near = sorted((-alike(name, s["name"], True), s["name"], s["no"], s["maker_key"]) for s in staged)
        tries = [[x for x in inside if same(p["maker_key"], x[3])], [x for x in [y for y in near if -y[0] >= 0.5][:5] if same(p["maker_key"], x[3])], [x for x in near if -x[0] >= 0.6 and len(name) >= 5][:1]]
        for number, found in enumerate(tries, 1):
            if found:
                want.append((p["id"], found[0][2], number))
                break
    got = QUERIES["match_ingredients_all"](spark, DATA).collect()
    assert sorted((r.product_id, r.report_no, r.pass_no) for r in got) == sorted(want) and len(want) > 100


def most_ranked(monkeypatch):
    """The numbers of rows that are ranked from here on."""
    counts = []

    def counted(df, *a, f=dedup.first_per_group, **b):
        counts.append(df.count())
        return f(df, *a, **b)

    monkeypatch.setattr(dedup, "first_per_group", counted)
    monkeypatch.setattr(link, "first_per_group", counted)
    return counts


def test_many_products_and_facts_of_one_name(spark, monkeypatch):
    counts = most_ranked(monkeypatch)
    products = spark.range(400).select(F.col("id").alias("product_id"), F.lit("R").alias("report_no"), F.lit("현미 누룽지 과자").alias("product_name"), F.lit("두레").alias("maker"))
    facts = spark.range(400).select((F.col("id") + 1000).alias("fact_id"), F.lit("현미누룽지과자").alias("product_name"), F.lit("두레").alias("maker"))
    reports = spark.createDataFrame([(1, "R", "다른 이름")], "id int, report_no string, name string")
    best, decisions = enrich.match_facts(products, facts, reports)
    assert {(r.product_id, r.fact_id, r.pass_no) for r in best.collect()} == {(k, 1000, 1) for k in range(400)}
    assert decisions.count() == 400
    assert max(counts) <= 400


def test_many_products_and_lists_of_one_name(spark, monkeypatch):
    counts = most_ranked(monkeypatch)
    products = spark.range(400).select(F.col("id").alias("product_id"), F.when(F.col("id") > 0, "현미 누룽지 과자").alias("product_name"), F.lit("두레").alias("maker"))
    staged = spark.range(400).select(F.format_string("%03d", "id").alias("report_no"), F.lit("현미 누룽지 과자 둘").alias("name"), F.when(F.col("id") % 8 == 7, "두레").otherwise("다른곳").alias("maker"))
    got = enrich.match_ingredients(products, staged, loose=True).collect()
    assert {(r.product_id, r.report_no, r.sim, r.pass_no) for r in got} == {(k, "007", 1.0, 1) for k in range(1, 400)}
    assert max(counts) <= 400


def test_many_facts_of_one_normal_name(spark, monkeypatch):
    counts = most_ranked(monkeypatch)
    rows = lambda key, start: spark.range(start, start + 200).select(F.col("id").alias(key), F.lit("현미누룽지과자").alias("normalized_name"), F.lit("두레").alias("normalized_maker"), F.concat(F.lit("현미 누룽지 과자 "), F.col("id").cast("string")).alias("product_name"))
    matches, decisions = link.fuzzy_facts(rows("product_id", 0), rows("fact_id", 1000))
    assert sorted((r.fact_id, r.product_id) for r in matches.collect()) == [(1000, 0), (1001, 1), (1002, 2)]
    assert decisions.count() == 200
    assert max(counts) <= 200


def test_merge_lists_no_pairs_of_rows(spark, monkeypatch):
    """Every product's maker is alike to every fact's, so all pairs of rows reach the score."""
    for place in (link, matching):
        monkeypatch.setattr(place, "match_blocks", None)
    rows = lambda key, start: spark.range(start, start + 300).select(F.col("id").alias(key), F.lit("현미 누룽지 과자").alias("product_name"), F.concat(F.lit("두레식품 제조"), F.col("id") % 3).alias("manufacturer"))
    got = link.merge_datasets(rows("left_id", 0), rows("right_id", 300), 0.8).collect()
    assert {(r.left_id, r.right_id, r.score) for r in got} == {(k, k + 300, 1.0) for k in range(300)}


@pytest.mark.parametrize("least, settled", [(0.8, None), (0.5, None), (0.5, 0)])
def test_merge_against_a_loop_over_all_pairs(spark, monkeypatch, least, settled):
    rng = random.Random(5)
    name = lambda: rng.choice([None, "", *(f"{a}{b}{c}" for a in ("", "[특가] ") for b in ("쌀 과자", "쌀 과자 둘", "현미 누룽지 과자") for c in ("", " 120g", " 500ml"))])
    maker = lambda: rng.choice([None, "", "가", "나", "가나", "(주)가나식품", "가나식품 둘", "다라", "㈜다라상회", "Brand#1", "Brand#12"])
    left = spark.createDataFrame([(k, name(), maker()) for k in rng.sample(range(-40, 400), 90)] + [(None, "쌀 과자", "가")], "left_id int, product_name string, manufacturer string")
    # Some facts have two names or makers.
    right = spark.createDataFrame([(rng.randrange(70), name(), maker()) for _ in range(90)] + [(None, "쌀 과자", "가")], "right_id long, product_name string, manufacturer string")
    sides = [df.selectExpr(f"{k} AS {x}", f"product_name AS n{x}", f"manufacturer AS m{x}") for df, k, x in ((left, "left_id", "a"), (right, "right_id", "b"))]
    edges = sides[0].crossJoin(sides[1]).where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", S.composite(F.col("na"), F.col("ma"), F.col("nb"), F.col("mb")).alias("s")).where(F.col("s") >= least)
    best = {}
    for r in edges.collect():
        best[r.a, r.b] = max(r.s, best.get((r.a, r.b), 0))
    want = greedy([(a, b, s) for (a, b), s in best.items()])
    if settled is not None:
        monkeypatch.setattr(link, "match_composite", lambda *a, f=matching.match_composite: f(*a, settled=settled))
    got = link.merge_datasets(left, right, least)
    assert got.dtypes == [("left_id", "int"), ("right_id", "bigint"), ("score", "double")]
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == sorted(want) and len(want) > 30
    assert all(r.score == best[r.left_id, r.right_id] for r in got.collect())


def test_parts_of_one_name_and_maker_are_products_and_facts_each(spark, tmp_path):
    # Keys of this distance have the same words before and behind their name and maker.
    keys = [5, 2315, 4625]
    spark.createDataFrame([(k, "hot nut", "Brand#7", "LARGE", 33, 900.0) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["fuzzy_decisions_all"](spark, str(tmp_path)).collect()
    assert sorted((r.fact_id, r.product_id, r.status) for r in got) == [(1_000_000 + k, k, "matched") for k in keys]


def test_a_fact_behind_three_of_another_unit_is_tried(spark):
    products = spark.createDataFrame([(1, "R", "현미 누룽지 과자 2L", "두레"), (2, "R", "현미 누룽지 과자 2L", "다른곳"), (3, "R", "현미 누룽지 과자 2oz", "두레")], "product_id int, report_no string, product_name string, maker string")
    facts = [(10 + k, f"현미 누룽지 과자 {k}0g", "두레") for k in range(1, 5)] + [(15, "현미 누룽지 과자맛 30g", "두레"), (16, "현미 누룽지 과자 500ml", "두레"), (17, "현미 누룽지 과자 500ml", "두레")]
    reports = spark.createDataFrame([(1, "R", "다른 이름")], "id int, report_no string, name string")
    best, decisions = enrich.match_facts(products, spark.createDataFrame(facts, "fact_id int, product_name string, maker string"), reports)
    assert sorted((r.product_id, r.fact_id, r.pass_no) for r in best.collect()) == [(1, 16, 1), (2, 16, 3), (3, 11, 1)]
    # Of facts of one text and unit family the smallest id is named.
    assert sorted((r.product_id, r.fact_id) for r in decisions.where("status = 'rejected'").collect()) == [(1, 11), (1, 15), (2, 11)]
