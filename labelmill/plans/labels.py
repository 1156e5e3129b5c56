"""Labels of all parts, and dictionaries and thresholds from whole tables, for the parsers and rules.

A part's label is written from its columns, so SQL says what must be read from it without reading it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import extract as E
from labelmill.functions import normalize as N
from labelmill.functions import parse as P
from labelmill.operators import labels, rules, score
from labelmill.plans.registry import query
from labelmill.plans.texts import _MAKER_FORM, _PART_NAMES, DICTIONARY, part_labels, part_names
from labelmill.session import table

_SECTION = "p_name || '(' || p_brand || ' ' || p_size || '%), 설탕 ' || p_size || '.5%, 분유(네덜란드산), ' || CASE p_size % 3 WHEN 0 THEN '혼합제제(구연산, 비타민C)' WHEN 1 THEN '두부' ELSE '새우분말' END || CASE WHEN p_size % 2 = 0 THEN ', 밀가루' ELSE '' END"
#: A part has a label unless its key is divisible by 11, and its facts stand on it unless the key is divisible by 5.
_P = "(SELECT *, p_partkey % 11 <> 0 AS labelled, p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 AS told, p_partkey * 37 % 3000 AS sodium, p_size % 10 + 0.5 AS sugars, p_size % 9 + 0.25 AS total_fat, p_size % 4 AS sat_fat, p_size // 2 AS carbs, p_size % 7 AS protein FROM part)"


def full_labels(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, size) of all parts: bullets, ingredients, and facts in the spellings that labels have."""
    size, key = F.col("p_size"), F.col("p_partkey")
    mixed = F.when(size % 3 == 0, "혼합제제(구연산, 비타민C)").when(size % 3 == 1, "두부").otherwise("새우분말")
    section = [F.col("p_name"), F.lit("("), F.col("p_brand"), F.lit(" "), size, F.lit("%), 설탕 "), size, F.lit(".5%, 분유(네덜란드산), "), mixed, F.when(size % 2 == 0, ", 밀가루").otherwise("")]
    told = [
        *(F.lit(" 영양정보 1회 제공량 "), size, F.when(key % 2 == 0, " g").otherwise("mL"), F.lit(" 열량 "), size * 7, F.lit("kcal 나트륨:"), key * 37 % 3000, F.lit(" mg 탄수화물 "), F.floor(size / 2)),
        *(F.lit("g 당류 "), size % 10, F.lit(",5g 단백질 "), size % 7, F.lit("g 지방 "), size % 9, F.lit(".25g 포화지방산 "), size % 4, F.lit(" g 트랜스지방 0."), size % 10, F.lit("g 콜레스테롤 "), size, F.lit("mg")),
    ]
    text = F.concat(F.when(key % 3 == 0, "●원재료명 및 함량: ").when(key % 3 == 1, "원재료명 ").otherwise("◆ 원재료: "), *section, F.when(key % 5 == 0, " 유통기한 별도표기").otherwise(F.concat(*told)))
    return table(spark, d, "part").select(key.alias("id"), F.when(key % 11 != 0, text).alias("label"), size.alias("size"))


@query("nutrients_all", f"""SELECT p_partkey AS id, CASE WHEN told THEN p_size * 7.0 END AS calories, CASE WHEN told THEN CAST(carbs AS DOUBLE) END AS total_carbs, CASE WHEN told THEN CAST(sugars AS DOUBLE) END AS total_sugars, CASE WHEN told THEN CAST(protein AS DOUBLE) END AS protein,
  CASE WHEN told THEN CAST(total_fat AS DOUBLE) END AS total_fat, CASE WHEN told THEN CAST(sat_fat AS DOUBLE) END AS saturated_fat, CASE WHEN told THEN p_size % 10 / 10.0 END AS trans_fat, CASE WHEN told THEN CAST(p_size AS DOUBLE) END AS cholesterol, CASE WHEN told THEN CAST(sodium AS DOUBLE) END AS sodium, CAST(NULL AS DOUBLE) AS dietary_fiber,
  CASE WHEN told THEN CAST(p_size AS DOUBLE) END AS serving_size, CASE WHEN told THEN CASE WHEN p_partkey % 2 = 0 THEN 'g' ELSE 'ml' END END AS serving_unit FROM {_P}""")
def nutrients_all(spark, d):
    size, unit = E.serving(F.col("label"))
    return full_labels(spark, d).select("id", *(c.alias(n) for n, c in E.nutrients(F.col("label")).items()), size.alias("serving_size"), unit.alias("serving_unit"))


@query("sections_all", f"SELECT p_partkey AS id, CASE WHEN labelled THEN {_SECTION} END AS section FROM {_P}")
def sections_all(spark, d):
    return full_labels(spark, d).select("id", E.ingredient_section(F.col("label")).alias("section"))


@query("percent_origin_all", f"SELECT p_partkey AS id, CASE WHEN labelled THEN CAST(p_size AS DOUBLE) END AS percentage, CASE WHEN labelled THEN '네덜란드산' END AS origin FROM {_P}")
def percent_origin_all(spark, d):
    return full_labels(spark, d).select("id", E.percentage(F.col("label")).alias("percentage"), E.origin(F.col("label")).alias("origin"))


@query("allergen_groups_all", f"""SELECT p_partkey AS id, CASE WHEN labelled THEN array_to_string(list_filter([CASE WHEN p_size % 3 = 1 THEN '대두' END, CASE WHEN p_size % 2 = 0 THEN '밀' END, CASE WHEN p_size % 3 = 2 THEN '새우' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS allergens FROM {_P}""")
def allergen_groups_all(spark, d):
    return full_labels(spark, d).select("id", F.array_join(E.allergens(F.col("label")), ",").alias("allergens"))


@query("numbers_all", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS parsed, CASE WHEN l_linenumber % 4 = 0 OR l_quantity = 0 THEN NULL ELSE l_quantity END AS parsed_or_null, l_discount AS rate, nullif(l_discount, 0) AS rate_or_null FROM lineitem""")
def numbers_all(spark, d):
    """Quantities of all lines as texts with units, white space and other words."""
    q = F.col("l_quantity").cast("string")
    text = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("N/A "), q)).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("  +"), q, F.lit("g"))).otherwise(F.concat(q, F.lit(" %")))
    rate = F.regexp_replace(F.format_string("%.2f", "l_discount"), "^0", "")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.number(text).alias("parsed"), E.number_or_null(text).alias("parsed_or_null"), E.number(rate).alias("rate"), E.number_or_null(rate).alias("rate_or_null"))


@query("ingredient_explode_all", """WITH r AS (SELECT p_partkey AS id, [p_name, p_brand, p_type, '설탕 ' || p_size || '.5%', '분유', '소금'] || CASE WHEN p_size % 3 = 0 THEN ['바다', '정제'] ELSE [] END || CASE WHEN p_size % 5 = 0 THEN ['산도조절제)'] ELSE [] END AS names FROM part)
  SELECT id, i - 1 AS place, names[i] AS name FROM r, unnest(generate_series(1, len(names))) t(i)""")
def ingredient_explode_all(spark, d):
    rows = part_labels(spark, d).select("id", F.posexplode(P.ingredient_names(P.parse_ingredient_tree(F.col("label")))).alias("place", "name"))
    return rows.select("id", F.col("place").cast("long").alias("place"), "name")


@query("label_blocks_all", """SELECT p_partkey AS id, array_to_string(list_filter(CASE WHEN p_size % 7 = 0 THEN [] WHEN p_size % 2 = 0 THEN [p_name, p_brand] ELSE [p_name, p_type, p_brand] END, lambda x: true), chr(10)) AS txt,
  CASE WHEN p_size % 7 = 0 THEN 0.0 WHEN p_size % 2 = 0 THEN p_size / 100.0 / 2 ELSE (p_size / 100.0 + 1.5) / 3 END AS confidence FROM part""")
def label_blocks_all(spark, d):
    """Recognised blocks of all parts, one without a confidence where there are two."""
    block = lambda text, sure: F.struct(F.col(text).alias("text"), sure.cast("double").alias("confidence"))
    name, brand = block("p_name", F.col("p_size") / 100), block("p_brand", F.when(F.col("p_size") % 2 != 0, 0.5))
    blocks = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<struct<text:string,confidence:double>>")).when(F.col("p_size") % 2 == 0, F.array(name, brand)).otherwise(F.array(name, block("p_type", F.lit(1.0)), brand))
    return labels.flatten_blocks(table(spark, d, "part").select(F.col("p_partkey").alias("id"), blocks.alias("blocks")), "id", "blocks").withColumnRenamed("text", "txt")


@query("analyze_labels_all", f"""WITH f AS (SELECT *, CAST(p_size AS DOUBLE) AS s, sodium / 2000.0 * 100 AS share, sodium / p_size * 100 AS per_100 FROM {_P}), r AS (SELECT *, CASE WHEN share <= 10 THEN 1 WHEN share <= 25 THEN 2 ELSE 4 END AS a, CASE WHEN per_100 <= 120 THEN 1 WHEN per_100 <= 600 THEN 2 ELSE 4 END AS b,
    per_100 > 40000 OR sugars / s * 100 > 100 OR total_fat / s * 100 > 100 OR sat_fat / s * 100 > 100 OR protein / s * 100 > 100 OR p_size % 10 / 10.0 / s * 100 > 100 OR sat_fat > total_fat AS insane FROM f)
  SELECT p_partkey AS id, CASE WHEN labelled THEN 4 + CAST(p_size % 2 = 0 AS INTEGER) ELSE 0 END AS n_items, CASE WHEN labelled AND p_size % 3 = 0 THEN 2 ELSE 0 END AS n_additives, CASE WHEN told THEN CASE greatest(a, b) WHEN 1 THEN 'green' WHEN 2 THEN 'yellow' ELSE 'red' END END AS sodium_color,
    CASE WHEN p_size / 50.0 < 0.7 THEN 'low_confidence' WHEN told AND insane THEN 'sanity_failed' WHEN told AND carbs + protein + total_fat > s * 1.1 THEN 'mass_balance' END AS reject_reason FROM r""")
def analyze_labels_all(spark, d):
    none = F.lit(None)
    rows = full_labels(spark, d).select("id", F.col("label").alias("text"), (F.col("size") / 50).alias("confidence"), F.lit("이름").alias("product_name"), F.lit("과자").alias("food_type"), F.lit("g").alias("content_unit"), none.cast("double").alias("total_content"))
    out = labels.analyze_labels(rows, DICTIONARY)
    return out.select("id", F.greatest(F.size("items"), F.lit(0)).alias("n_items"), F.greatest(F.size("found_additives"), F.lit(0)).alias("n_additives"), "sodium_color", "reject_reason")


_CONFIG = "(SELECT ['sodium', 'sugars', 'total_fat', 'sat_fat', 'protein'][CAST(o_custkey % 5 + 1 AS INTEGER)] || '_' || o_custkey // 5 % 40 AS nutrient, CASE WHEN o_orderkey % 2 = 0 THEN 'green_max' ELSE 'yellow_max' END AS threshold, CASE WHEN o_orderkey % 3 = 0 THEN 'per_100g' ELSE 'pct_dv' END AS basis, o_totalprice AS value, ['adult', 'child', 'adult', 'elder'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS profile, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) END AS t FROM orders)"


@query("thresholds_all", f"""SELECT nutrient, threshold, basis, value FROM {_CONFIG} WHERE f <= DATE '1998-06-01' AND coalesce(t, DATE '9999-12-31') >= DATE '1998-06-01' AND profile IN ('adult', 'child')
  QUALIFY row_number() OVER (PARTITION BY nutrient, threshold, basis ORDER BY profile = 'child' DESC, f DESC, value DESC) = 1""")
def thresholds_all(spark, d):
    """Every order as a threshold of a nutrient, valid from its date on, for adults, children or the old."""
    key, began = F.col("o_orderkey"), F.to_date("o_orderdate")
    pick = lambda words, n: F.array(*map(F.lit, words))[n.cast("int")]
    config = table(spark, d, "orders").select(
        F.concat(pick(("sodium", "sugars", "total_fat", "sat_fat", "protein"), F.col("o_custkey") % 5), F.lit("_"), F.floor(F.col("o_custkey") / 5) % 40).alias("nutrient"),
        F.when(key % 2 == 0, "green_max").otherwise("yellow_max").alias("threshold"),
        F.when(key % 3 == 0, "per_100g").otherwise("pct_dv").alias("basis"),
        F.col("o_totalprice").alias("value"),
        pick(("adult", "child", "adult", "elder"), key % 4).alias("profile"),
        began.alias("effective_from"),
        F.when(key % 7 != 0, F.date_add(began, (key % 900).cast("int"))).alias("effective_to"),
    )
    return rules.thresholds_as_of(config, "1998-06-01", "child")


@query("risk_colors_all", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 3 THEN 'green' WHEN 4 THEN 'yellow' ELSE 'gray' END AS color, CASE o_orderkey % 6 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 4 THEN 'yellow' ELSE 'green' END AS color_or_green FROM orders")
def risk_colors_all(spark, d):
    raw = F.array(*map(F.lit, ("RED", " Orange ", "purple", "green", "yellow")))
    color = F.get(raw, (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", score.seed_color(color).alias("color"), score.seed_color(color, gray_allowed=False).alias("color_or_green"))


@query("dictionary_texts_all", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_nationkey || ' mg/kg' WHEN 1 THEN 'not specified' WHEN 2 THEN 'group ' || s_name END AS intake,
  array_to_string(list_filter([CASE WHEN s_nationkey % 2 = 0 THEN 'use: ' || s_name END, CASE WHEN s_nationkey % 3 = 0 THEN 'source: ' || s_nationkey END], lambda x: x IS NOT NULL), ' | ') AS description FROM supplier""")
def dictionary_texts_all(spark, d):
    kind = F.get(F.array(*map(F.lit, ("numeric", "not_specified", "group"))), (F.col("s_suppkey") % 4).cast("int"))
    used, origin = F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")), F.when(F.col("s_nationkey") % 3 == 0, F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", score.intake_text(kind, F.col("s_nationkey"), F.lit("mg/kg"), F.col("s_name")).alias("intake"), score.description(use=used, source=origin).alias("description"))


@query("canonical_synonym_all", f"""WITH m AS (SELECT id, {_MAKER_FORM.format('maker')} AS form FROM {_PART_NAMES}) SELECT id, coalesce(n_name, form) AS canonical FROM m LEFT JOIN nation ON form = 'brand#' || n_nationkey""")
def canonical_synonym_all(spark, d):
    """Makers of all parts by a dictionary that knows some of them by a nation's name."""
    known = table(spark, d, "nation").select(F.concat(F.lit("brand#"), "n_nationkey").alias("form"), F.col("n_name").alias("canonical"))
    rows = part_names(spark, d).select("id", N.maker(F.col("maker")).alias("form"))
    return rows.join(known, "form", "left").select("id", F.coalesce("canonical", "form").alias("canonical"))


@query("humanise_all", """SELECT p_partkey, 'saturated fat ' || p_name || ', salt/' || p_type || ' xsat_fat sodium_' || p_size || ' total fat' AS label FROM part""")
def humanise_all(spark, d):
    code = F.concat(F.lit("sat_fat "), "p_name", F.lit(", sodium/"), "p_type", F.lit(" xsat_fat sodium_"), "p_size", F.lit(" total_fat"))
    return table(spark, d, "part").select("p_partkey", N.humanised(code, {"sat_fat": "saturated fat", "total_fat": "total fat", "sodium": "salt"}).alias("label"))


_FOOD = ["맥주", "장류", "과자", "유지류", "건과류", "", "과·채주스", "참기름"]
_TITLES = ["배추김치", "구운 김", "김밥", "김", "보리차 음료", "말린 망고", "김치전", "과일 칩", "건조 김치"]


def _category_sql(seaweed: bool) -> str:
    has = lambda c, *words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    kinds = f"WHEN {has('k', '주류', '맥주')} THEN 'alcohol' WHEN {has('k', '장류')} THEN 'fermented' WHEN {has('k', '과·채주스')} THEN 'beverage' WHEN {has('k', '건과류')} THEN 'dried'"
    names = f"WHEN {has('t', '김치')} THEN 'fermented' WHEN {has('t', '음료')} THEN 'beverage' WHEN {has('t', '말린', '건조')} THEN 'dried'"
    return f"CASE {kinds} WHEN u IN ('ml', 'L') AND NOT {has('k', '유지류', '참기름')} THEN 'beverage' {names} {'WHEN ' + chr(39) + '김' + chr(39) + ' = t[-1:] OR t LIKE ' + chr(39) + '%김 %' + chr(39) + ' THEN ' + chr(39) + 'dried' + chr(39) if seaweed else ''} ELSE 'general' END"


@query("food_categories_all", f"""WITH r AS (SELECT o_orderkey, [{', '.join(f"'{x}'" for x in _FOOD)}][CAST(o_orderkey % {len(_FOOD)} + 1 AS INTEGER)] AS k, [{', '.join(f"'{x}'" for x in _TITLES)}][CAST(o_custkey % {len(_TITLES)} + 1 AS INTEGER)] AS t, ['g', 'ml', 'L', 'kg'][CAST(o_custkey % 4 + 1 AS INTEGER)] AS u FROM orders)
  SELECT o_orderkey, {_category_sql(True)} AS category, {_category_sql(False)} AS report_category FROM r""")
def food_categories_all(spark, d):
    """The scorer's own rules of categories, and the copy that quality reports have, which knows no seaweed, over all orders."""
    pick = lambda words, n: F.array(*map(F.lit, words))[(F.col(n) % len(words)).cast("int")]
    of = [pick(_FOOD, "o_orderkey"), pick(("g", "ml", "L", "kg"), "o_custkey"), pick(_TITLES, "o_custkey")]
    return table(spark, d, "orders").select("o_orderkey", score.food_category(*of).alias("category"), score.food_category(*of, seaweed=False).alias("report_category"))


_WORDS = "regexp_replace(regexp_replace(regexp_replace(trim(name), '\\s+', ' ', 'g'), '[()（）\\[\\]【】]', '', 'g'), '[,，·•]', ' ', 'g')"
for _size in ("[gG][rR]?", "[mM][lL]", "[kK][gG]", "[lL]"):
    _WORDS = f"regexp_replace({_WORDS}, '[0-9]+\\s*{_size}', '', 'g')"


@query("name_words_all", f"SELECT id, lower(trim(regexp_replace({_WORDS}, '\\s+', ' ', 'g'))) AS words FROM {_PART_NAMES}")
def name_words_all(spark, d):
    return part_names(spark, d).select("id", N.name(F.col("name")).alias("words"))


@query("volumes_all", f"""WITH r AS (SELECT id, regexp_extract(name, '([0-9]+[.,]?[0-9]*)\\s*(ml|kg|l|g)', 1, 'i') AS v, lower(regexp_extract(name, '([0-9]+[.,]?[0-9]*)\\s*(ml|kg|l|g)', 2, 'i')) AS u FROM {_PART_NAMES}),
  s AS (SELECT id, u, CAST(replace(nullif(v, ''), ',', '.') AS DOUBLE) * CASE WHEN u IN ('l', 'kg') THEN 1000 ELSE 1 END AS x FROM r)
  SELECT id, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END || CASE WHEN u IN ('l', 'ml') THEN 'ml' ELSE 'g' END AS volume, CASE WHEN u IN ('l', 'ml') THEN 'ml' WHEN u IN ('g', 'kg') THEN 'g' END AS family FROM s""")
def volumes_all(spark, d):
    return part_names(spark, d).select("id", E.volume(F.col("name")).alias("volume"), E.unit_family(F.col("name")).alias("family"))
