"""Enrichment steps, review of contributions, and whole labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.operators import admin, enrich, labels, search
from labelmill.plans.registry import golden, query
from labelmill.plans.scoring import _J, _WORD_GRAMS, _both_sides
from labelmill.plans.texts import _MAKER_FORM, _PART_NAMES, DICTIONARY, LABELS, part_names
from labelmill.session import table


@query("synthetic_keys", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NO_BARCODE_' || CAST(c_custkey AS VARCHAR) ELSE c_name END AS barcode, CASE WHEN c_custkey % 2 = 0 THEN 'g' ELSE 'ml' END AS unit FROM customer")
def synthetic_keys(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("barcode"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise("ml").alias("unit"))
    return enrich.with_keys(rows, "barcode", "c_custkey", "unit")


@query("report_enrichment", """WITH p AS (SELECT c_custkey AS product_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS report_no, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS food_type, true AS is_active, c_custkey % 5 = 0 AS enriched FROM customer),
  r AS (SELECT o_custkey AS report_no, o_orderpriority AS new_type, CASE WHEN o_orderstatus = 'F' THEN '아니오' WHEN o_orderstatus = 'O' THEN '예' END AS production FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
  SELECT product_id, CASE WHEN t THEN coalesce(food_type, new_type) ELSE food_type END AS food_type, CASE WHEN t THEN coalesce(production <> '아니오', true) ELSE is_active END AS is_active, t OR enriched AS enriched FROM (SELECT p.*, r.new_type, r.production, r.report_no IS NOT NULL AND NOT enriched AS t FROM p LEFT JOIN r ON p.report_no = r.report_no)""")
def report_enrichment(spark, d):
    c = F.col("c_custkey")
    products = table(spark, d, "customer").select(c.alias("product_id"), F.when(c % 4 != 0, c).alias("report_no"), F.when(c % 3 == 0, F.col("c_mktsegment")).alias("food_type"), F.lit(True).alias("is_active"), (c % 5 == 0).alias("enriched"))
    reports = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("report_no"), F.col("o_orderpriority").alias("food_type"), F.when(F.col("o_orderstatus") == "F", "아니오").when(F.col("o_orderstatus") == "O", "예").alias("production"))
    return enrich.enrich_from_reports(products, reports)[0].drop("report_no")


@query("reject_reasons", """SELECT CASE WHEN t THEN 'matched' WHEN report_no IS NULL OR enriched THEN 'skipped' ELSE 'rejected' END AS status, CASE WHEN NOT t AND report_no IS NOT NULL AND NOT enriched THEN 'no_report' END AS reason, count(*) AS n
  FROM (SELECT *, report_no IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND report_no IS NOT NULL AND NOT enriched AS t FROM (SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS report_no, c_custkey % 5 = 0 AS enriched FROM customer)) GROUP BY ALL""")
def reject_reasons(spark, d):
    c = F.col("c_custkey")
    none = F.lit(None).cast("string")
    products = table(spark, d, "customer").select(c.alias("product_id"), F.when(c % 4 != 0, c).alias("report_no"), none.alias("food_type"), F.lit(True).alias("is_active"), (c % 5 == 0).alias("enriched"))
    reports = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("report_no"), none.alias("food_type"), none.alias("production"))
    return enrich.enrich_from_reports(products, reports)[1].groupBy("status", "reason").agg(F.count("*").alias("n"))


@query("register_ingredients", """SELECT c_custkey AS product_id, string_agg(o_orderpriority, ', ' ORDER BY o_orderkey) AS raw_text FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0 AND o_orderpriority <> '5-LOW' GROUP BY c_custkey""")
def register_ingredients(spark, d):
    products = table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_custkey").alias("report_no"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("report_no"), F.when(F.col("o_orderpriority") == "5-LOW", F.lit("  ")).otherwise(F.col("o_orderpriority")).alias("name"))
    return enrich.register_ingredients(products, lines, products.where("product_id % 3 = 0"))


@query("official_names", "SELECT c_custkey AS product_id, max_by(o_orderpriority, o_orderkey) AS official_name FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def official_names(spark, d):
    products = table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_custkey").alias("report_no"))
    return enrich.official_names(products, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("report_no"), F.col("o_orderpriority").alias("name")))


@golden("match_facts_passes", "SELECT * FROM (VALUES (1, 11, 1), (2, 12, 2), (3, 13, 3)) t(product_id, fact_id, pass_no)")
def match_facts_passes(spark, d):
    products = spark.createDataFrame([(1, None, "달콤한 사과칩 매운맛 120g", "(주)푸른들"), (2, "R2", "이름없는 음료", "한드링크"), (3, None, "현미 누룽지 과자 고소한맛 오리지널", "두레"), (4, None, "탄산 음료 오렌지 스페셜 500ml", "한드링크")], "product_id int, report_no string, product_name string, maker string")
    facts = spark.createDataFrame([(11, "달콤한사과칩 매운맛", "푸른들 주식회사"), (12, "오렌지 과즙 음료", "한드링크"), (13, "현미누룽지과자 고소한맛오리지널", "다른곳"), (14, "탄산음료 오렌지 스페셜 500g", "한드링크")], "fact_id int, product_name string, maker string")
    reports = spark.createDataFrame([(1, "R2", "처음 이름"), (2, "R2", "오렌지과즙음료")], "id int, report_no string, name string")
    return enrich.match_facts(products, facts, reports)[0].select("product_id", "fact_id", "pass_no")


@golden("match_ingredients_passes", "SELECT * FROM (VALUES (1, 'A', 1), (2, 'C', 2), (3, 'D', 3)) t(product_id, report_no, pass_no)")
def match_ingredients_passes(spark, d):
    products = spark.createDataFrame([(1, "사과칩", "(주)푸른들"), (2, "현미 과자 고소한맛", "두레"), (3, "오렌지 과즙 음료", "한드링크"), (4, "없는 이름", "없음")], "product_id int, product_name string, maker string")
    staged = spark.createDataFrame([("A", "달콤 사과칩", "푸른들"), ("B", "사과칩", "다른곳"), ("C", "현미 과자 고소한 맛", "두레"), ("D", "오렌지 과즙 음료 스페셜", "다른곳")], "report_no string, name string, maker string")
    return enrich.match_ingredients(products, staged, loose=True).select("product_id", "report_no", "pass_no")


@query("match_facts_all")
def match_facts_all(spark, d):
    """All parts as products against all parts, named otherwise, as facts, in three passes."""
    products, facts = _both_sides(spark, d)
    official = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("report_no"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    products = products.select(F.col("id").alias("product_id"), F.col("id").cast("string").alias("report_no"), F.col("name").alias("product_name"), "maker")
    facts = facts.select(F.col("id").alias("fact_id"), F.col("name").alias("product_name"), "maker")
    return enrich.match_facts(products, facts, official)[0].select("product_id", "fact_id", "pass_no")


@query("match_ingredients_all")
def match_ingredients_all(spark, d):
    """All parts as products against the distinct names and makers of all parts as staged lists."""
    products, staged = _both_sides(spark, d)
    staged = staged.groupBy("name", "maker").agg(F.min("id").cast("string").alias("report_no"))
    return enrich.match_ingredients(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "maker"), staged, loose=True).select("product_id", "report_no", "pass_no")


@golden("substring_facts", "SELECT * FROM (VALUES (11, 1), (12, 2)) t(fact_id, product_id)")
def substring_facts(spark, d):
    products = spark.createDataFrame([(1, "red apple chips"), (2, "green apple chips"), (3, "cola")], "product_id int, product_name string")
    facts = spark.createDataFrame([(11, "apple"), (12, "apple chips"), (13, "chips"), (14, "tea")], "fact_id int, food_name string")
    return enrich.substring_facts(products, facts)


@query("maker_synonyms", f"""WITH m AS (SELECT maker, count(*) AS n_lacking FROM {_PART_NAMES} WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) GROUP BY maker ORDER BY n_lacking DESC, maker LIMIT 50), s AS (SELECT DISTINCT p_brand || ' ' || p_type AS candidate FROM part),
  g AS (SELECT *, {_WORD_GRAMS.format('maker')} AS x, {_MAKER_FORM.format('maker')} AS f FROM m), h AS (SELECT *, {_WORD_GRAMS.format('candidate')} AS y, {_MAKER_FORM.format('candidate')} AS c FROM s),
  r AS (SELECT maker, n_lacking, candidate, f, c, {_J.format('x', 'y')} AS sim FROM g, h WHERE length(f) >= 2 AND {_J.format('x', 'y')} >= 0.3 QUALIFY row_number() OVER (PARTITION BY maker ORDER BY sim DESC, candidate) <= 10)
  SELECT maker, n_lacking, candidate, sim FROM r WHERE NOT (c <> '' AND (contains(f, c) OR contains(c, f)))""")
def maker_synonyms(spark, d):
    """Makers of all parts without a large order line, against brands with their types."""
    registered = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("product_id"))
    staged = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("maker"))
    return enrich.maker_synonyms(part_names(spark, d).select(F.col("id").alias("product_id"), "maker"), registered, staged)


@query("substring_facts_all", f"""WITH RECURSIVE p AS (SELECT id AS product_id, lower(name) AS held FROM {_PART_NAMES}), f AS (SELECT p_partkey + 1000000 AS fact_id, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[2] ELSE p_name END AS food, row_number() OVER (ORDER BY p_partkey) AS i FROM part WHERE p_partkey % 5 <> 0),
  c AS (SELECT food, list(product_id ORDER BY product_id) AS ids FROM (SELECT DISTINCT food FROM f) JOIN p ON contains(held, food) GROUP BY food),
  g AS (SELECT CAST(0 AS BIGINT) AS i, bitstring('0', (SELECT CAST(max(p_partkey) + 1 AS INTEGER) FROM part)) AS used, CAST(NULL AS BIGINT) AS fact_id, CAST(NULL AS BIGINT) AS product_id
        UNION ALL SELECT i, CASE WHEN x IS NULL THEN used ELSE set_bit(used, CAST(x AS INTEGER), 1) END, fact_id, x FROM (SELECT f.i, g.used, f.fact_id, list_filter(c.ids, lambda y: get_bit(g.used, CAST(y AS INTEGER)) = 0)[1] AS x FROM g JOIN f ON f.i = g.i + 1 LEFT JOIN c USING (food)))
  SELECT fact_id, product_id FROM g WHERE product_id IS NOT NULL""")
def substring_facts_all(spark, d):
    """Names of parts, and bare nouns for every third, as foods; all parts, named as products are, to hold them."""
    part = table(spark, d, "part").where("p_partkey % 5 <> 0")
    facts = part.select((F.col("p_partkey") + 1_000_000).alias("fact_id"), F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[1]).otherwise(F.col("p_name")).alias("food_name"))
    return enrich.substring_facts(part_names(spark, d).select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), facts)


@query("additive_groups", """SELECT l_partkey, greatest(max(CASE s_nationkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 1 END), 1) AS dominant_rank, count(*) AS n, min(s_name) AS first_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey""")
def additive_groups(spark, d):
    rank = F.when(F.col("s_nationkey") % 4 == 1, 2).when(F.col("s_nationkey") % 4 == 2, 4).otherwise(1)
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    out = enrich.additive_groups(table(spark, d, "lineitem"), suppliers, "l_partkey", "l_suppkey", "s_name", "s_nationkey", rank)
    return out.select("l_partkey", "dominant_rank", F.size("additives").cast("long").alias("n"), F.col("additives")[0]["s_name"].alias("first_name"))


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("product_id"), F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "P", "disputed").otherwise("unverified").alias("verification"), F.col("o_orderdate").alias("verified_at"))


@query("admin_approve", "SELECT verification, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IN (SELECT user_id FROM events WHERE event_id IN (1, 2, 3, 4)) THEN 'admin_verified' WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderstatus = 'P' THEN 'disputed' ELSE 'unverified' END AS verification FROM orders) GROUP BY verification")
def admin_approve(spark, d):
    contributions = table(spark, d, "events").select(F.col("event_id").alias("contribution_id"), F.col("user_id").alias("product_id"), F.lit("pending").alias("status"))
    return admin.approve(_orders(spark, d), contributions, [1, 2, 3, 4])[0].groupBy("verification").agg(F.count("*").alias("n"))


@query("admin_reject", "SELECT count(*) AS facts, count(*) FILTER (l_returnflag = 'R') AS contributed FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_partkey IN (SELECT user_id FROM events WHERE event_id < 50))")
def admin_reject(spark, d):
    facts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.when(F.col("l_returnflag") == "R", "contribution").alias("data_source"))
    contributions = table(spark, d, "events").select(F.col("event_id").alias("contribution_id"), F.col("user_id").alias("product_id"), F.lit("pending").alias("status"))
    return admin.reject(facts, contributions, list(range(50)))[0].agg(F.count("*").alias("facts"), F.count("data_source").alias("contributed"))


@query("admin_correct", "SELECT p_partkey AS product_id, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE p_retailprice END AS price, p_brand AS brand FROM part")
def admin_correct(spark, d):
    part = table(spark, d, "part")
    facts = part.select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    fixes = facts.where("product_id % 2 = 0").select("product_id", F.lit(0.0).alias("price"), F.lit(None).cast("string").alias("brand"))
    contributions = spark.createDataFrame([(1, 2, "pending")], "contribution_id int, product_id long, status string")
    return admin.correct(facts, contributions, [1], fixes, ["price", "brand"])[0]


@query("report_disputes", "SELECT verification, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3) THEN 'disputed' WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderstatus = 'P' THEN 'disputed' ELSE 'unverified' END AS verification FROM orders) GROUP BY verification")
def report_disputes(spark, d):
    counts = table(spark, d, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("product_id")).agg((F.count("*") >= 3).alias("disputed"))
    return admin.flag_disputed(_orders(spark, d), counts).groupBy("verification").agg(F.count("*").alias("n"))


@query("dashboard", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'P') AS disputed, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS stale, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 1) AS verified_rate FROM orders")
def dashboard(spark, d):
    return admin.dashboard(_orders(spark, d), F.lit("2000-01-01").cast("timestamp"))


@query("pending_allergens", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'disputed' ELSE 'pending' END AS status FROM events WHERE event_type IN ('error', 'view') AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def pending_allergens(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    data = F.when(k >= 50, F.lit('{"allergens": ["밀"]}')).when(k >= 25, F.lit('{"allergens": []}')).otherwise(F.lit("{}"))
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "disputed").when(F.col("event_type") == "view", "pending").otherwise("closed").alias("status"), data.alias("data"), F.col("ts").alias("created_at"))
    return search.pending(rows, "allergen").select("event_id", "status")


@golden("label_blocks", "SELECT * FROM (VALUES (1, 'a' || chr(10) || 'b', 0.75), (2, '', 0.0)) t(id, txt, confidence)")
def label_blocks(spark, d):
    rows = spark.createDataFrame([(1, [("a", 1.0), ("b", 0.5)]), (2, [])], "id int, blocks array<struct<text:string,confidence:double>>")
    return labels.flatten_blocks(rows, "id", "blocks").withColumnRenamed("text", "txt")


@golden("analyze_labels", "SELECT * FROM (VALUES (1, 5, 3, 'red', NULL), (2, 3, 1, NULL, 'low_confidence'), (3, 3, 1, 'green', NULL), (4, 0, 0, NULL, NULL), (5, 0, 0, NULL, 'low_confidence')) t(id, n_items, n_additives, sodium_color, reject_reason)")
def analyze_labels(spark, d):
    confidence = {1: 0.95, 2: 0.5, 3: 0.8, 4: 0.9, 5: None}
    rows = spark.createDataFrame([(i, t, confidence[i], "이름", "과자", "g", None) for i, t in LABELS], "id int, text string, confidence double, product_name string, food_type string, content_unit string, total_content double")
    out = labels.analyze_labels(rows, DICTIONARY, [("나트류", "나트륨")])
    return out.select("id", F.greatest(F.size("items"), F.lit(0)).alias("n_items"), F.greatest(F.size("found_additives"), F.lit(0)).alias("n_additives"), "sodium_color", "reject_reason")
