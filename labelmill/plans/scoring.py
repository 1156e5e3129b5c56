"""Scoring, context, sanity and linkage, bound to stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import normalize as N
from labelmill.functions import similarity as S
from labelmill.operators import dedup, enrich, link, quality, rules, score, search
from labelmill.plans.registry import golden, query
from labelmill.plans.texts import part_names
from labelmill.session import table

TYPE_RULES = [("alcohol", ["PROMO"]), ("beverage", ["SMALL"]), ("dried", ["ECONOMY"])]
NAME_RULES = [("fermented", ["ring"]), ("beverage", ["bolt"]), ("dried", ["gear"])]
_CATEGORY = """CASE WHEN contains(p_type, 'PROMO') THEN 'alcohol' WHEN contains(p_type, 'SMALL') THEN 'beverage' WHEN contains(p_type, 'ECONOMY') THEN 'dried' WHEN p_size % 10 = 0 AND NOT contains(p_type, 'LARGE') THEN 'beverage'
  WHEN contains(p_name, 'ring') THEN 'fermented' WHEN contains(p_name, 'bolt') THEN 'beverage' WHEN contains(p_name, 'gear') THEN 'dried' ELSE 'general' END"""
_FACTS = """SELECT p_partkey, p_name, p_type, p_size, calories, sodium, sugars, sat_fat, total_fat, cholesterol, protein, fiber, trans_fat FROM part LEFT JOIN (SELECT l_partkey, sum(l_extendedprice) / 1000 AS calories, min(l_extendedprice) / 40 AS sodium, avg(l_quantity) AS sugars,
  max(l_discount) * 100 + 0.0 AS sat_fat, max(l_tax) * 200 + 0.0 AS total_fat, max(l_quantity) * 3 AS cholesterol, min(l_quantity) AS protein, count(*) * 0.5 AS fiber, CASE WHEN max(l_discount) > 0.09 THEN 0.6 WHEN max(l_discount) > 0.08 THEN 0.0 END AS trans_fat
  FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey) ON l_partkey = p_partkey"""


def exact_sum(c: Column) -> Column:
    """Sum of doubles of up to eight decimals that no order of the rows changes; plain where one isn't finite or is 1e20 or more."""
    exact = c.try_cast("decimal(28,8)")
    return F.when(F.count(c) == F.count(exact), F.sum(exact).cast("double")).otherwise(F.sum(c))


def fact_columns() -> list[Column]:
    """Nutrients of a part as aggregates of its lines."""
    return [
        (exact_sum(F.col("l_extendedprice")) / 1000).alias("calories"),
        (F.min("l_extendedprice") / 40).alias("sodium"),
        F.avg("l_quantity").alias("sugars"),
        (F.max("l_discount") * 100 + 0.0).alias("sat_fat"),
        (F.max("l_tax") * 200 + 0.0).alias("total_fat"),
        (F.max("l_quantity") * 3).alias("cholesterol"),
        F.min("l_quantity").alias("protein"),
        (F.count("*") * 0.5).alias("fiber"),
        F.when(F.max("l_discount") > 0.09, 0.6).when(F.max("l_discount") > 0.08, 0.0).alias("trans_fat"),
    ]


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Nutrients of parts: aggregates of their lines."""
    return table(spark, d, "lineitem").where("l_partkey % 7 <> 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(*fact_columns())


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("product_name"), F.col("p_type").alias("food_type"), F.when(F.col("p_size") % 10 == 0, "ml").otherwise("g").alias("content_unit"), F.col("p_size").cast("double").alias("serving_size"), (F.col("p_size") * 2.5).alias("total_content"))


def _category():
    return score.food_category(F.col("food_type"), F.col("content_unit"), F.col("product_name"), seaweed=False, type_rules=TYPE_RULES, name_rules=NAME_RULES, not_beverage=["LARGE"])


def _limit(x, pair):
    return f"CASE WHEN {x} <= {pair[0]} THEN 1 WHEN {x} <= {pair[1]} THEN 2 WHEN {x} IS NOT NULL THEN 4 END"


def _traffic_sql() -> str:
    cols = []
    for n, cut in rules.NEGATIVE_PCT.items():
        amount = f"CASE WHEN NOT is_excluded THEN {n} END"
        share = f"({amount}) / {rules.DAILY_VALUES[n]} * 100"
        a = _limit(share, cut)
        if n in rules.PER_100G:
            per = f"CASE WHEN cat <> 'dried' THEN ({amount}) / p_size * 100 END"
            b = f"CASE WHEN cat = 'beverage' THEN {_limit(per, rules.PER_100ML[n])} ELSE {_limit(per, rules.PER_100G[n])} END"
        else:
            b = "NULL"
        cols.append(f"greatest({a}, {b}) AS {n}_rank, CASE WHEN ({amount}) IS NULL THEN NULL WHEN coalesce(({b}) > ({a}), false) THEN CASE WHEN cat = 'beverage' THEN 'per_100ml' ELSE 'per_100g' END ELSE 'pct_dv' END AS {n}_basis, floor(({share}) * 10 + 0.5) / 10 AS {n}_pct_dv")
    return f"SELECT p_partkey, cat AS food_category, {', '.join(cols)} FROM (SELECT *, cat = 'alcohol' AS is_excluded FROM (SELECT *, {_CATEGORY} AS cat FROM ({_FACTS})))"


@query("traffic_light_wide", _traffic_sql())
def traffic_light_wide(spark, d):
    out = score.evaluate(products(spark, d).join(facts(spark, d), "p_partkey", "left"), _category())
    cols = [c for n in rules.NEGATIVE_PCT for c in (score.color_rank(F.col(f"{n}_color")).alias(f"{n}_rank"), F.col(f"{n}_basis"), F.col(f"{n}_pct_dv"))]
    return out.select("p_partkey", "food_category", *cols)


@query("traffic_light_positive", f"""SELECT p_partkey, CASE WHEN p < 5 THEN 'gray' WHEN p >= 15 THEN 'green' WHEN p IS NOT NULL THEN 'yellow' END AS protein_color, CASE WHEN f < 5 THEN 'gray' WHEN f >= 15 THEN 'green' WHEN f IS NOT NULL THEN 'yellow' END AS fiber_color,
  CASE WHEN t <= 0 THEN 'green' WHEN t <= 0.5 THEN 'yellow' WHEN t IS NOT NULL THEN 'red' END AS trans_fat_color, floor(c / 2000.0 * 100 * 10 + 0.5) / 10 AS calories_pct_dv, CASE WHEN NOT x THEN 2.5 END AS servings_per_container
  FROM (SELECT p_partkey, x, CASE WHEN NOT x THEN protein END / 55.0 * 100 AS p, CASE WHEN NOT x THEN fiber END / 25.0 * 100 AS f, CASE WHEN NOT x THEN trans_fat END AS t, CASE WHEN NOT x THEN calories END AS c FROM (SELECT *, ({_CATEGORY}) = 'alcohol' AS x FROM ({_FACTS})))""")
def traffic_light_positive(spark, d):
    out = score.evaluate(products(spark, d).join(facts(spark, d), "p_partkey", "left"), _category())
    return out.select("p_partkey", "protein_color", "fiber_color", "trans_fat_color", "calories_pct_dv", "servings_per_container")


@query("category_counts", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark, d):
    return quality.frequency(products(spark, d).select(_category().alias("category")), "category")


@golden("category_goldens", "SELECT * FROM (VALUES (1, 'general'), (2, 'beverage'), (3, 'dried'), (4, 'alcohol'), (5, 'fermented'), (6, 'general'), (7, 'dried'), (8, 'general'), (9, 'supplement'), (10, 'general')) t(id, category)")
def category_goldens(spark, d):
    rows = [(1, "과자", "g", "감자칩"), (2, None, "mL", "제로 탄산"), (3, "건과류", "g", "사과"), (4, "맥주", "ml", "라거"), (5, None, "g", "총각김치"), (6, "식용유지", "ml", "콩기름"), (7, None, None, "구운김"), (8, None, None, "참치김밥"), (9, "건강기능식품", "g", "비타"), (10, None, None, None)]
    df = spark.createDataFrame(rows, "id int, food_type string, content_unit string, product_name string")
    return df.select("id", score.food_category(F.col("food_type"), F.col("content_unit"), F.col("product_name")).alias("category"))


@golden("context_categories", "SELECT * FROM (VALUES (1, 'fermented', '발효식품', false, 'c005_food_type'), (2, 'beverage', '음료', false, 'c005_food_type'), (3, 'health_functional', '건강기능식품', true, 'c005_food_type'), (4, 'general', '일반 가공식품', false, 'silent_fallback'), (5, 'general', '일반 가공식품', false, 'c005_food_type'), (6, 'soup', '국·찌개', false, 'c005_food_type')) t(id, category, category_label, is_excluded, detection_method)")
def context_categories(spark, d):
    df = spark.createDataFrame([(1, "김치류"), (2, "과·채주스"), (3, "건강기능식품"), (4, "  "), (5, "스낵과자"), (6, "수프류")], "id int, food_type string")
    c = score.context(F.col("food_type"))
    return df.select("id", *(c[k].alias(k) for k in ("category", "category_label", "is_excluded", "detection_method")))


@golden("score_goldens", "SELECT * FROM (VALUES (1, 'red', 'per_100g'), (2, 'red', 'pct_dv'), (3, 'yellow', 'pct_dv'), (4, 'red', 'per_100g'), (5, 'yellow', 'per_100g'), (6, NULL, NULL)) t(id, sodium_color, sodium_basis)")
def score_goldens(spark, d):
    rows = [(1, "과자", "칩", 30.0, 200.0), (2, "유탕면", "컵", 65.0, 1600.0), (3, "건과류", "말랭이", 25.0, 350.0), (4, "과자", "젤리", 15.0, 150.0), (5, "과자", "바", 30.0, 80.0), (6, "맥주", "라거", 355.0, 10.0)]
    df = spark.createDataFrame(rows, "id int, food_type string, product_name string, serving_size double, sodium double")
    none = F.lit(None).cast("double")
    df = df.withColumns({"content_unit": F.lit("g"), "total_content": none, **{n: none for n in ("calories", "sugars", "sat_fat", "total_fat", "cholesterol", "protein", "fiber", "trans_fat")}})
    return score.evaluate(df).select("id", "sodium_color", "sodium_basis")


@golden("config_as_of", "SELECT * FROM (VALUES ('sodium', 'green_max', 'pct_dv', 10.0), ('sodium', 'yellow_max', 'pct_dv', 20.0), ('sugars', 'green_max', 'per_100g', 4.0)) t(nutrient, threshold, basis, value)")
def config_as_of(spark, d):
    rows = [("sodium", "green_max", "pct_dv", 12.0, "adult", "2020-01-01", "2023-12-31"), ("sodium", "green_max", "pct_dv", 10.0, "adult", "2024-01-01", None), ("sodium", "yellow_max", "pct_dv", 25.0, "adult", "2020-01-01", None), ("sodium", "yellow_max", "pct_dv", 20.0, "child", "2022-01-01", None), ("sugars", "green_max", "per_100g", 4.0, "child", "2020-01-01", "2024-06-01"), ("sugars", "yellow_max", "per_100g", 9.0, "child", "2025-01-01", None)]
    config = spark.createDataFrame(rows, "nutrient string, threshold string, basis string, value double, profile string, f string, t string").select("nutrient", "threshold", "basis", "value", "profile", F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"))
    return rules.thresholds_as_of(config, "2024-06-01", "child")


@query("sanity_warnings", """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS s, l_extendedprice / 10 - 200 AS calories, l_discount * 1000 + 0.0 AS total_fat, l_tax * 1000 + 0.0 AS sat_fat, l_quantity / 2 AS protein, l_quantity / 3 AS carbs FROM lineitem), w AS (
  SELECT *, 'calories' AS nutrient, 'negative_value' AS kind FROM f WHERE calories < 0 UNION ALL SELECT *, 'calories', 'per_serving_exceeded' FROM f WHERE calories > 2000 UNION ALL SELECT *, 'calories', 'per_100g_exceeded' FROM f WHERE calories >= 0 AND s > 0 AND calories / s * 100 > 900
  UNION ALL SELECT *, 'total_fat', 'per_100g_exceeded' FROM f WHERE s > 0 AND total_fat / s * 100 > 100 UNION ALL SELECT *, 'sat_fat', 'per_100g_exceeded' FROM f WHERE s > 0 AND sat_fat / s * 100 > 100 UNION ALL SELECT *, 'sat_fat', 'exceeds_total_fat' FROM f WHERE sat_fat > total_fat
  UNION ALL SELECT *, 'mass_balance', 'mass_balance_exceeded' FROM f WHERE s > 0 AND carbs + protein + total_fat > s * 1.1
  UNION ALL SELECT *, 'calories_cross_check', 'calorie_deviation' FROM f WHERE carbs * 4 + protein * 4 + total_fat * 9 > 0 AND abs(calories - (carbs * 4 + protein * 4 + total_fat * 9)) / (carbs * 4 + protein * 4 + total_fat * 9) > 0.3)
  SELECT nutrient, kind, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM w GROUP BY ALL""")
def sanity_warnings(spark, d):
    q = F.col("l_quantity")
    facts_of = {"calories": F.col("l_extendedprice") / 10 - 200, "total_fat": F.col("l_discount") * 1000 + 0.0, "sat_fat": F.col("l_tax") * 1000 + 0.0, "protein": q / 2}
    return score.warning_counts(table(spark, d, "lineitem"), "l_orderkey", q, facts_of, carbs=q / 3).withColumnRenamed("n_keys", "orders")


@query("mass_balance_note", "SELECT event_id, CASE WHEN value * 2 / coalesce(nullif(k, 0), 100) > 1.1 THEN 'mass_balance:' || CAST(floor(value * 2 / coalesce(nullif(k, 0), 100) * 100 + 0.5) / 100 AS VARCHAR) END IS NOT NULL AS noted FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)")
def mass_balance_note(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("event_id", score.mass_balance_note(k, F.col("value"), F.lit(None).cast("double"), F.col("value")).isNotNull().alias("noted"))


@query("additive_summary", """WITH b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), c AS (SELECT l_partkey, ['green', 'yellow', 'red', 'gray'][s_nationkey % 4 + 1] AS color FROM b JOIN supplier ON l_suppkey = s_suppkey)
  SELECT l_partkey, count(*) AS total, count(*) FILTER (color = 'green') AS n_green, count(*) FILTER (color = 'yellow') AS n_yellow, count(*) FILTER (color = 'orange') AS n_orange, count(*) FILTER (color = 'red') AS n_red,
  CASE WHEN count(*) FILTER (color = 'red') > 0 THEN 'red' WHEN count(*) FILTER (color = 'yellow') > 0 THEN 'yellow' ELSE 'green' END AS dominant FROM c GROUP BY l_partkey""")
def additive_summary(spark, d):
    colors = F.array(*map(F.lit, ("green", "yellow", "red", "gray")))
    additives = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), colors[F.col("s_nationkey") % 4].alias("color"))
    return search.additive_summary(table(spark, d, "lineitem"), additives, "l_partkey", "l_suppkey", "color")


@golden("risk_colors", "SELECT * FROM (VALUES ('RED', 'red'), (' orange', 'yellow'), ('purple', 'gray'), ('green', 'green')) t(raw, color)")
def risk_colors(spark, d):
    df = spark.createDataFrame([("RED",), (" orange",), ("purple",), ("green",)], "raw string")
    return df.select("raw", score.seed_color(F.col("raw")).alias("color"))


@golden("dictionary_texts", "SELECT * FROM (VALUES (1, '5 mg/kg', 'use: acid | source: fruit'), (2, 'not specified', 'use: colour'), (3, 'group ADI-3', ''), (4, NULL, 'source: salt')) t(id, intake, description)")
def dictionary_texts(spark, d):
    df = spark.createDataFrame([(1, "numeric", 5, "mg/kg", None, "acid", "fruit"), (2, "not_specified", None, None, None, "colour", None), (3, "group", None, None, "ADI-3", None, None), (4, None, None, None, None, None, "salt")], "id int, kind string, v int, unit string, g string, used string, origin string")
    return df.select("id", score.intake_text(F.col("kind"), F.col("v"), F.col("unit"), F.col("g")).alias("intake"), score.description(use=F.col("used"), source=F.col("origin")).alias("description"))


@query("nutrient_sources", f"""SELECT p_partkey, count(*) AS n FROM ({' UNION ALL '.join(f"SELECT p_partkey FROM t WHERE {n}_rank IN (2, 4)" for n in rules.NEGATIVE_PCT)}) GROUP BY p_partkey""".replace("SELECT p_partkey, count(*)", f"WITH t AS ({_traffic_sql()}) SELECT p_partkey, count(*)"))
def nutrient_sources(spark, d):
    out = score.evaluate(products(spark, d).join(facts(spark, d), "p_partkey", "left"), _category())
    return score.sources(out, "p_partkey").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("product_card", f"""WITH t AS ({_traffic_sql()}), s AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS total FROM lineitem GROUP BY l_partkey)
  SELECT t.p_partkey, food_category, sodium_rank, coalesce(total, 0) AS n_additives FROM t LEFT JOIN s ON l_partkey = p_partkey""")
def product_card(spark, d):
    """Facts and additives of a part come from its lines in one aggregation."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(*fact_columns(), F.countDistinct("l_suppkey").alias("total"))
    known = F.col("p_partkey") % 7 != 0
    lines = lines.select("p_partkey", "total", *(F.when(known, F.col(c)).alias(c) for c in lines.columns if c not in ("p_partkey", "total")))
    out = search.product_card(products(spark, d), "p_partkey", lines, category=_category())
    return out.select("p_partkey", "food_category", score.color_rank(F.col("sodium_color")).alias("sodium_rank"), F.coalesce("total", F.lit(0)).alias("n_additives"))


_G = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring('  ' || {0} || ' ', i, 3)))"
_J = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"


@query("match_topk_then_filter", f"""WITH n AS (SELECT p_name, p_brand, min(p_partkey) AS k FROM part GROUP BY p_name, p_brand), a AS (SELECT k AS src, p_name AS t, p_brand AS b, {_G.format('p_name')} AS s FROM n WHERE k % 3 = 0), x AS (SELECT k AS dst, p_name AS u, p_brand AS b, {_G.format('p_name')} AS s FROM n WHERE k % 3 <> 0),
  c AS (SELECT src, dst, {_J.format('a.s', 'x.s')} AS sim FROM a JOIN x ON a.b = x.b WHERE {_J.format('a.s', 'x.s')} >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rk FROM c)
  SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rk) AS first FROM r WHERE rk <= 3 AND dst % 2 = 0) WHERE first = 1""")
def match_topk_then_filter(spark, d):
    n = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"))
    left, right = n.where("k % 3 = 0").select(F.col("k").alias("src"), "p_name", "p_brand"), n.where("k % 3 <> 0").select(F.col("k").alias("dst"), "p_name", "p_brand")
    pairs = link.top_k_join(left, right, "src", "dst", "p_name", 3, 0.3, block="p_brand")
    return link.top_then_filter(pairs, "src", [F.col("sim").desc(), F.col("dst")], F.col("dst") % 2 == 0)


_OTHER = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' 120g' ELSE p_name END"


@query("match_cascade", f"""WITH p AS (SELECT p_partkey AS src, p_name AS t, p_brand AS b FROM part), s AS (SELECT p_partkey AS dst, {_OTHER} AS u, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS b FROM part),
  c AS (SELECT src, min(dst) AS dst, 1 AS pass_no FROM p JOIN s ON t = u AND p.b = s.b GROUP BY src UNION ALL SELECT src, min(dst), 2 FROM p JOIN s ON t = u GROUP BY src UNION ALL SELECT src, min(dst), 3 FROM p JOIN s ON string_split(t, ' ')[1] = string_split(u, ' ')[1] GROUP BY src)
  SELECT src, dst, pass_no FROM c QUALIFY row_number() OVER (PARTITION BY src ORDER BY pass_no) = 1""")
def match_cascade(spark, d):
    """Every part against a copy of all parts whose names and brands are changed here and there."""
    part = table(spark, d, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    p = part.select(key.alias("src"), "p_name", "p_brand", F.split("p_name", " ")[0].alias("head"))
    other = F.when(key % 4 == 1, F.upper(name)).when(key % 4 == 2, F.concat(name, F.lit(" 120g"))).otherwise(name)
    s = part.select(key.alias("dst"), other.alias("p_name"), F.when(key % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type")).alias("p_brand")).withColumn("head", F.split("p_name", " ")[0])

    def found(keys):
        # Only the smallest partner of each key can win, so the right side is reduced first.
        return p.select("src", *keys).join(s.groupBy(*keys).agg(F.min("dst").alias("dst")), keys).select("src", "dst")

    return link.cascade([found(["p_name", "p_brand"]), found(["p_name"]), found(["head"])], "src", [F.col("dst")])


@query("match_exclusive_greedy", """WITH RECURSIVE e AS (SELECT s_suppkey AS l, n_nationkey AS r, 1.0 - abs(s_suppkey % 25 - n_nationkey) / 25.0 AS w FROM supplier JOIN nation ON abs(s_suppkey % 25 - n_nationkey) <= 2), o AS (SELECT l, row_number() OVER (ORDER BY l) AS i FROM (SELECT DISTINCT l FROM e)),
  g AS (SELECT 0 AS i, CAST([] AS INTEGER[]) AS used, CAST(NULL AS BIGINT) AS l, CAST(NULL AS INTEGER) AS r
        UNION ALL SELECT o.i, CASE WHEN b.r IS NULL THEN g.used ELSE list_append(g.used, b.r) END, o.l, b.r FROM g JOIN o ON o.i = g.i + 1 LEFT JOIN LATERAL (SELECT e.r FROM e WHERE e.l = o.l AND NOT list_contains(g.used, e.r) ORDER BY e.w DESC, e.r LIMIT 1) b ON true WHERE len(g.used) < (SELECT count(*) FROM nation))
  SELECT l AS left_id, r AS right_id FROM g WHERE r IS NOT NULL""")
def match_exclusive_greedy(spark, d):
    # Each supplier meets the at most five nations around its own number: an equi-join after exploding them.
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("left_id"), F.explode(F.sequence((F.col("s_suppkey") % 25 - 2).cast("int"), (F.col("s_suppkey") % 25 + 2).cast("int"))).alias("right_id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("right_id"))
    edges = s.join(n, "right_id").select("left_id", "right_id", (1.0 - F.abs(F.col("left_id") % 25 - F.col("right_id")) / 25.0).alias("score"))
    return link.exclusive_match(edges, "left_id", "right_id", "score").select("left_id", "right_id")


@golden("merge_parts", "SELECT * FROM (VALUES ('matched', 1, 11), ('matched', 2, 12), ('left_only', 3, NULL), ('right_only', NULL, 13)) t(part, left_id, right_id)")
def merge_parts(spark, d):
    left = spark.createDataFrame([(1, "달콤 사과칩 120g", "(주)푸른들"), (2, "제로 콜라 355ml", "한드링크"), (3, "두유 1L", "두레")], "left_id int, product_name string, manufacturer string")
    right = spark.createDataFrame([(11, "달콤 사과칩", "푸른들"), (12, "제로콜라 355ml", "한드링크 주식회사"), (13, "두유 500ml", "두레")], "right_id int, product_name string, manufacturer string")
    return link.outer_parts(left, right, link.merge_datasets(left, right, 0.55), "left_id", "right_id")


@golden("fuzzy_decisions", "SELECT * FROM (VALUES (21, 'matched', 1), (22, 'rejected', 2), (22, 'pooled', NULL), (23, 'pooled', NULL)) t(fact_id, status, product_id)")
def fuzzy_decisions(spark, d):
    def rows(data, key):
        df = spark.createDataFrame(data, f"{key} long, product_name string, maker string")
        return df.select(key, "product_name", N.product_name(F.col("product_name")).alias("normalized_name"), N.strip_corporate(F.col("maker")).alias("normalized_maker"))

    p = rows([(1, "달콤 사과칩 매운맛", "(주)푸른들"), (2, "과일 음료 오렌지 스페셜 에디션 1L", "한드링크"), (3, "현미 과자 고소한맛", "두레")], "product_id")
    f = rows([(21, "달콤 사과칩 (매운맛)", "푸른들"), (22, "과일 음료 오렌지 스페셜 에디션 1g", "한드링크"), (23, "전혀 다른 이름", "두레")], "fact_id")
    return link.fuzzy_facts(p, f)[1].select(F.col("fact_id").cast("int").alias("fact_id"), "status", F.col("product_id").cast("int").alias("product_id"))


@query("funnel", """SELECT 'all' AS step, count(*) AS n FROM customer UNION ALL SELECT 'with_orders', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT 'with_done', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def funnel(spark, d):
    state = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    one = table(spark, d, "customer").select("c_custkey").join(state, "c_custkey", "left").agg(F.count("*").alias("all"), F.count("done").alias("with_orders"), F.count_if(F.col("done").isNull()).alias("without_orders"), F.count_if(F.col("done") == 1).alias("with_done"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("step"), F.col(c).alias("n")) for c in ("all", "with_orders", "without_orders", "with_done")))).alias("r")).select("r.*")


@query("blind_test_grade", """WITH c AS (SELECT p_brand, (CASE WHEN p_size > 5 THEN 1 ELSE 0 END) * (CASE WHEN p_retailprice > 905 THEN 1 ELSE 0 END) AS clean FROM part)
  SELECT p_brand, avg(clean) AS clean_ratio, CASE WHEN avg(clean) >= 0.9 THEN 'A' WHEN avg(clean) >= 0.75 THEN 'B' WHEN avg(clean) >= 0.6 THEN 'C' ELSE 'D' END AS grade FROM c GROUP BY p_brand""")
def blind_test_grade(spark, d):
    clean = ((F.col("p_size") > 5) & (F.col("p_retailprice") > 905)).cast("int")
    out = table(spark, d, "part").groupBy("p_brand").agg(F.avg(clean).alias("clean_ratio"))
    return out.withColumn("grade", quality.grade(F.col("clean_ratio")))


_WORD_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9가-힣]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("synonym_candidates", f"""WITH n AS (SELECT p_name || ' ' || p_type AS m, count(*) AS c FROM part GROUP BY 1 ORDER BY c DESC, m LIMIT 50), a AS (SELECT m AS t, {_WORD_GRAMS.format('m')} AS s FROM n), x AS (SELECT u, {_WORD_GRAMS.format('u')} AS s FROM (SELECT DISTINCT p_name || ' ' || p_brand AS u FROM part UNION SELECT DISTINCT p_name FROM part)),
  c AS (SELECT t AS name, u AS candidate, {_J.format('a.s', 'x.s')} AS sim FROM a, x WHERE {_J.format('a.s', 'x.s')} >= 0.3) SELECT name, candidate FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sim DESC, candidate) AS r FROM c) WHERE r <= 10 AND NOT contains(name, candidate) AND NOT contains(candidate, name)""")
def synonym_candidates(spark, d):
    """For the 50 commonest names the ten most alike ones by words' trigrams, without those that hold each other."""
    part = table(spark, d, "part")
    top = quality.frequency(part.select(F.concat_ws(" ", "p_name", "p_type").alias("m")), "m").orderBy(F.col("n").desc(), "m").limit(50).select("m", F.col("m").alias("name"))
    every = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("m")).union(part.select("p_name")).distinct().select("m", F.col("m").alias("candidate"))
    best = link.top_k_join(top, every, "name", "candidate", "m", 10, 0.3, gram=S.word_trigrams)
    return best.where(~F.contains("name", F.col("candidate")) & ~F.contains("candidate", F.col("name"))).select("name", "candidate")


def _both_sides(spark, d):
    """All parts as products and, named otherwise, as facts."""
    rows = part_names(spark, d)
    other = F.concat(F.regexp_replace("name", "^(\\[특가\\]|달콤|미니 파우치) *", ""), F.when(F.col("id") % 3 == 0, " 특").otherwise(""))
    return rows, rows.select((F.col("id") + 1_000_000).alias("id"), other.alias("name"), "maker")


@query("merge_parts_all")
def merge_parts_all(spark, d):
    """Every part as a product against every part as a fact, on distinct names and makers; greedy in order, so without SQL."""
    left, right = (df.groupBy("name", "maker").agg(F.min("id").alias(k)).select(k, F.col("name").alias("product_name"), F.col("maker").alias("manufacturer")) for df, k in zip(_both_sides(spark, d), ("left_id", "right_id")))
    return link.outer_parts(left, right, link.merge_datasets(left, right, 0.8), "left_id", "right_id")


@query("fuzzy_decisions_all")
def fuzzy_decisions_all(spark, d):
    """Every part as a fact against every part as a product, also of equal names, by names inside a maker, with thresholds for lengths and unit families."""
    forms = {"product_name": F.col("name"), "normalized_name": N.product_name(F.col("name")), "normalized_maker": N.strip_corporate(F.col("maker"))}
    products, facts = (df.select(F.col("id").alias(k), *(c.alias(n) for n, c in forms.items())) for df, k in zip(_both_sides(spark, d), ("product_id", "fact_id")))
    return link.fuzzy_facts(products, facts)[1]


@query("match_rates", "WITH s AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'matched' WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'pooled' END AS status FROM orders) SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM s), 1) AS rate FROM s GROUP BY status")
def match_rates(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pooled")
    return enrich.match_rates(table(spark, d, "orders").select(status.alias("status")))


_TYPES = ["김치류", "과·채주스", "건강기능식품", "  ", "스낵과자", "수프류", "육포", "견과류", "연유", "통밀가루", "카레", "맥주", "농산물", "음료류"]
_SAID = {"김치류": "fermented_sodium_context", "과·채주스": "beverage_per_100ml", "건강기능식품": "health_functional_excluded", "수프류": "soup_broth_amount", "육포": "dried_per_serving_only", "견과류": "nuts_healthy_fat", "연유": "dairy_calcium", "통밀가루": "dried_per_serving_only", "카레": "sauce_small_serving", "맥주": "alcohol_excluded", "농산물": "raw_excluded", "음료류": "beverage_per_100ml"}
_TYPE_SQL = "[" + ", ".join(f"'{t}'" for t in _TYPES) + f"][CAST(p_partkey AS INTEGER) % {len(_TYPES)} + 1]"


@query("context_messages", f"""SELECT p_partkey, t AS food_type, CASE t {' '.join(f"WHEN '{t}' THEN '{m}'" for t, m in _SAID.items())} END AS message, CASE t WHEN '건강기능식품' THEN 'health_functional' WHEN '맥주' THEN 'alcohol' WHEN '농산물' THEN 'raw_ingredient' END AS exclude_reason FROM (SELECT p_partkey, {_TYPE_SQL} AS t FROM part)""")
def context_messages(spark, d):
    kinds = F.array(*map(F.lit, _TYPES))[(F.col("p_partkey") % len(_TYPES)).cast("int")]
    rows = table(spark, d, "part").select("p_partkey", kinds.alias("food_type"))
    c = score.context(F.col("food_type"))
    return rows.select("p_partkey", "food_type", F.get(c["messages"], F.lit(0))["id"].alias("message"), c["exclude_reason"].alias("exclude_reason"))


@query("score_messages", f"""SELECT p_partkey, CASE WHEN cat = 'alcohol' THEN 'alcohol' END AS exclude_reason, CASE WHEN cat <> 'alcohol' THEN CAST(cat IN ('dried', 'fermented') AS INTEGER) END AS n_messages,
  CASE WHEN cat <> 'alcohol' AND trans_fat = 0 THEN '식약처 규정에 따라 0.2g 미만은 0g으로 표시될 수 있습니다.' END AS trans_fat_note, CASE WHEN cat <> 'alcohol' THEN '이 제품은 2.5회분입니다. 전량 섭취 시 수치가 2.5배가 됩니다.' END AS servings_message FROM (SELECT *, {_CATEGORY} AS cat FROM ({_FACTS}))""")
def score_messages(spark, d):
    out = score.evaluate(products(spark, d).join(facts(spark, d), "p_partkey", "left"), _category())
    return out.select("p_partkey", "exclude_reason", F.when(F.col("context_messages").isNotNull(), F.size("context_messages")).alias("n_messages"), "trans_fat_note", "servings_message")


def _card_sql() -> str:
    number = lambda x: f"regexp_replace(CAST(CAST({x} AS DECIMAL(38, 2)) AS VARCHAR), '\\.?0+$', '')"
    icon = lambda x: f"CASE {x} WHEN 1 THEN '🟢' WHEN 2 THEN '🟡' WHEN 4 THEN '🔴' WHEN 0 THEN '⚪' END"
    lines = ["'┌─── ' || p_name || ' ───'", "'│  카테고리: ' || food_category || CASE WHEN food_category = 'dried' THEN ' (건조식품 예외 적용)' ELSE '' END", "'│'", f"'│  열량      ' || {number('calories')} || 'kcal   ' || {number('floor(calories / 2000.0 * 100 * 10 + 0.5) / 10')} || '%'"]
    for n, title, weighed in (("sodium", "나트륨　　　", True), ("sugars", "당류　　　　", True), ("sat_fat", "포화지방　　", True), ("total_fat", "지방　　　　", True), ("cholesterol", "콜레스테롤　", False)):
        weight = f"coalesce(' (100g: ' || {number(f'floor({n} / p_size * 100 * 100 + 0.5) / 100')} || ')', '')" if weighed else "''"
        weight = f"CASE WHEN food_category = 'dried' THEN '' ELSE {weight} END"
        lines.append(f"'│  {title}  ' || coalesce({icon(f'{n}_rank')} || ' ' || {number(f'{n}_pct_dv')} || '%' || {weight} || '  [' || {n}_basis || ']', '데이터 없음')")
    for n, title, daily in (("protein", "단백질　　　", 55.0), ("fiber", "식이섬유　　", 25.0)):
        share = f"{n} / {daily} * 100"
        lines.append(f"'│  {title}  ' || coalesce({icon(f'CASE WHEN {share} < 5 THEN 0 WHEN {share} >= 15 THEN 1 WHEN {n} IS NOT NULL THEN 2 END')} || ' ' || {number(f'floor({share} * 10 + 0.5) / 10')} || '%  [pct_dv]', '데이터 없음')")
    lines += [f"'│  트랜스지방　  ' || coalesce({icon('CASE WHEN trans_fat <= 0 THEN 1 WHEN trans_fat <= 0.5 THEN 2 WHEN trans_fat IS NOT NULL THEN 4 END')} || '   [absolute]', '데이터 없음')", "CASE WHEN trans_fat = 0 THEN '│    ⓘ 식약처 규정에 따라 0.2g 미만은 0g으로 표시될 수 있습니다.' END", "'│'", "'│  ⚠️ 이 제품은 2.5회분입니다. 전량 섭취 시 수치가 2.5배가 됩니다.'"]
    lines += ["CASE food_category WHEN 'dried' THEN '│' || chr(10) || '│  💬 건조식품으로 100g당 수치가 높게 표시됩니다. 1회 제공량 기준으로 판정하였습니다.' WHEN 'fermented' THEN '│' || chr(10) || '│  💬 발효식품은 나트륨이 높으나, 유산균·식이섬유 등 건강 유익 성분이 함께 포함되어 있습니다.' END", "'└───────────────────────'"]
    return f"SELECT p_partkey, CASE WHEN food_category = 'alcohol' THEN '⛔ ' || p_name || ': 주류는 영양 신호등 평가 대상이 아닙니다.' ELSE concat_ws(chr(10), {', '.join(lines)}) END AS card FROM ({_traffic_sql()}) JOIN (SELECT * REPLACE (floor(calories) AS calories) FROM ({_FACTS})) USING (p_partkey)"


@query("text_card", _card_sql())
def text_card(spark, d):
    """Whole calories, as a sum's last digits depend on its order."""
    whole = facts(spark, d).withColumn("calories", F.floor("calories").cast("double"))
    out = score.evaluate(products(spark, d).join(whole, "p_partkey", "left"), _category())
    return out.select("p_partkey", score.text_card().alias("card"))


@query("serving_unknown", f"""SELECT p_partkey, floor(sodium / p_size * 100 * 100 + 0.5) / 100 AS sodium_per_100 FROM (SELECT * REPLACE (CASE WHEN p_size % 4 <> 0 THEN p_size END AS p_size), {_CATEGORY} AS cat FROM ({_FACTS})) WHERE cat NOT IN ('alcohol', 'dried')""")
def serving_unknown(spark, d):
    """Without a default serving an unknown size leaves the absolute basis out."""
    rows = products(spark, d).join(facts(spark, d), "p_partkey", "left")
    out = score.evaluate(rows.withColumn("serving_size", F.when(F.col("serving_size") % 4 != 0, F.col("serving_size"))), _category(), default_serving=None)
    return out.where("NOT is_excluded AND NOT is_dried").select("p_partkey", "sodium_per_100")


_WORDS = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part UNION SELECT unnest(['Promo', 'ECONOMY', 'Brand#7', 'zzz', '밀']))"


def _keywords(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("keyword"))
    return words.union(spark.createDataFrame([(w,) for w in ("Promo", "ECONOMY", "Brand#7", "zzz", "밀")], "keyword string")).distinct()


@query("keyword_sources", f"""WITH k AS {_WORDS}, a AS (SELECT DISTINCT p_name AS n FROM part), b AS (SELECT DISTINCT p_type || ' ' || p_brand AS n FROM part),
  x AS (SELECT keyword, (SELECT n FROM a WHERE contains(lower(n), lower(keyword)) ORDER BY length(n), n LIMIT 1) AS first_name, (SELECT n FROM b WHERE contains(lower(n), lower(keyword)) ORDER BY length(n), n LIMIT 1) AS second_name FROM k)
  SELECT *, CASE WHEN first_name IS NOT NULL AND second_name IS NOT NULL THEN 'both' WHEN first_name IS NOT NULL THEN 'first' WHEN second_name IS NOT NULL THEN 'second' ELSE 'neither' END AS found_in FROM x""")
def keyword_sources(spark, d):
    part = table(spark, d, "part")
    first, second = part.select(F.col("p_name").alias("n")).distinct(), part.select(F.concat_ws(" ", "p_type", "p_brand").alias("n")).distinct()
    return quality.keyword_sources(_keywords(spark, d), first, second, "n", [F.length("n"), F.col("n")])


@query("keyword_coverage", f"""WITH k AS {_WORDS}, i AS (SELECT p_partkey, p_name || ' ' || p_brand AS n, p_size <= 30 AND p_type <> 'SMALL' AS active, p_retailprice > 901 AS filled FROM part)
  SELECT keyword, p_partkey, active FROM k LEFT JOIN (SELECT keyword AS w, p_partkey, active FROM k JOIN i ON contains(lower(n), lower(keyword)) QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY active DESC, filled DESC, length(n), p_partkey) = 1) ON w = keyword""")
def keyword_coverage(spark, d):
    items = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("n"), ((F.col("p_size") <= 30) & (F.col("p_type") != "SMALL")).alias("active"), (F.col("p_retailprice") > 901).alias("filled"))
    return quality.keyword_coverage(_keywords(spark, d), items, "n", F.col("active"), F.col("filled"), "p_partkey").select("keyword", "p_partkey", "active")


@query("anomaly_tops", """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS line, l_extendedprice AS price, l_quantity AS q, l_discount * 100 + l_tax * 100 AS shares FROM lineitem), a AS (SELECT 'price' AS kind, line, price AS value FROM e WHERE price > 50000 UNION ALL SELECT 'mass', line, q + shares FROM e WHERE q > 0 AND q + shares > q * 1.1 UNION ALL SELECT 'none', line, price FROM e WHERE price <= 0)
  SELECT kind, line, value FROM a QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value DESC, line) <= 10""")
def anomaly_tops(spark, d):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    total = q + (F.col("l_discount") * 100 + F.col("l_tax") * 100)
    lines = table(spark, d, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return quality.anomaly_tops(lines, "line", {"price": (price > 50000, price), "mass": ((q > 0) & (total > q * 1.1), total), "none": (price <= 0, price)})


@query("product_checks", f"""WITH f AS (SELECT *, {_CATEGORY} AS detected, CASE WHEN p_size % 6 <> 0 THEN p_name || ' (' || p_type || ')' END AS raw_text, CASE WHEN p_size % 4 = 0 THEN p_name || ' (' || p_type || ')' WHEN p_size % 4 = 1 THEN p_type END AS registered, CASE WHEN p_size % 5 = 0 THEN [] WHEN p_size % 5 = 1 THEN ['ＲＩＮＧ', p_type] ELSE [p_type] END AS adds,
  CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'beverage' ELSE 'general' END AS stored FROM ({_FACTS})), g AS (SELECT *, calories IS NOT NULL AS has_facts, coalesce(stored, 'general') AS cat, list_filter(adds, lambda a: raw_text IS NOT NULL AND NOT contains(replace(lower(raw_text), ' ', ''), CASE WHEN a = 'ＲＩＮＧ' THEN 'ring' ELSE lower(a) END)) AS unread,
  list_filter([CASE WHEN sodium * 400 > 10000 THEN 'sodium' END, CASE WHEN calories - 60 <= 0 THEN 'calories_low' END, CASE WHEN calories - 60 > 2000 THEN 'calories_high' END, CASE WHEN p_size > 0 AND total_fat + protein > p_size * 1.1 AND total_fat + protein > 10 THEN 'mass' END], lambda x: x IS NOT NULL) AS odd FROM f)
  SELECT p_partkey, CASE WHEN raw_text IS NOT NULL THEN 'O' ELSE 'X' END || CASE WHEN len(unread) > 0 THEN '△' WHEN len(adds) > 0 THEN 'O' ELSE '-' END || CASE WHEN NOT has_facts THEN 'X' WHEN len(odd) > 0 THEN '△' ELSE 'O' END || CASE WHEN NOT has_facts OR detected = 'alcohol' THEN '-' ELSE 'O' END || CASE WHEN detected = cat THEN 'O' WHEN cat = 'general' THEN '△' ELSE 'X' END AS marks,
  array_to_string(list_filter([CASE WHEN raw_text IS NULL THEN 'no_ingredients' WHEN registered IS NOT NULL AND registered <> raw_text THEN 'registered_text_differs' END, CASE WHEN len(unread) > 0 THEN 'additives_not_in_text:' || len(unread) END, CASE WHEN NOT has_facts THEN 'no_nutrition' WHEN len(odd) > 0 THEN 'anomaly:' || array_to_string(odd, ';') END, CASE WHEN detected <> cat THEN 'category:' || cat || '>' || detected END], lambda x: x IS NOT NULL), ' | ') AS issues FROM g""")
def product_checks(spark, d):
    size = F.col("serving_size").cast("int")
    rows = score.evaluate(products(spark, d).join(facts(spark, d), "p_partkey", "left"), _category())
    text = F.concat("product_name", F.lit(" ("), "food_type", F.lit(")"))
    judged = sum((F.col(f"{n}_color").isNotNull().cast("int") for n in rules.NEGATIVE_PCT), F.lit(0))
    rows = rows.select("p_partkey", F.when(size % 6 != 0, text).alias("raw_text"), F.when(size % 4 == 0, text).when(size % 4 == 1, F.col("food_type")).alias("registered_text"), F.when(size % 5 == 0, F.array().cast("array<string>")).when(size % 5 == 1, F.array(F.lit("ＲＩＮＧ"), "food_type")).otherwise(F.array("food_type")).alias("additives"), F.col("calories").isNotNull().alias("has_facts"), (F.col("sodium") * 400).alias("sodium"), (F.col("calories") - 60).alias("calories"), size.alias("serving"), F.col("total_fat").alias("fat"), F.lit(None).cast("double").alias("carbs"), "protein", "is_excluded", judged.alias("judged"), F.when(size % 3 == 1, "beverage").when(size % 3 == 2, "general").alias("category"), F.col("food_category").alias("detected"))
    out = quality.product_checks(rows)
    return out.select("p_partkey", F.concat("ingredients", "additives_check", "nutrition", "traffic_light", "category_check").alias("marks"), F.array_join("issues", " | ").alias("issues"))


@query("rerun_cleanup", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F') GROUP BY l_returnflag")
def rerun_cleanup(spark, d):
    return quality.frequency(dedup.cleared(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus="F"), "l_returnflag")
