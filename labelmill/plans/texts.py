"""Normalisers, similarity, extraction and parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import extract as E
from labelmill.functions import normalize as N
from labelmill.functions import parse as P
from labelmill.functions import similarity as S
from labelmill.operators import link, quality
from labelmill.plans.registry import golden, query
from labelmill.session import shared_dir, table
from labelmill.sources import trigram_index

# Invented label texts and names for the parsers and normalisers.
NAMES = [
    (1, "달콤 사과칩 (매운맛) 120g", "(주)푸른들식품"),
    (2, "  달콤·사과칩  봉지 1.5kg ", "푸른들식품 주식회사"),
    (3, "Cola_Zero 355ml x 24캔", "유한회사 Han Drink"),
    (4, "[특가] 두유 1L 팩 3", "농업회사법인 두레 제2공장"),
    (5, "", None),
    (6, "현미밥,210 G", "㈜한끼 부산공장"),
]
LABELS = [
    (1, "●원재료명 : 밀가루(밀:미국산, 호주산), 설탕 12.5%, 팜유{말레이시아산}, 혼합제제(구연산, 비타민C, 탄산칼슘), 정제소금 함유 영양정보 1회 제공량 30 g 열량 155kcal 나트륨:200 mg 탄수화물 20g 당류 5,5g 단백질 2g 지방 7.1g 포화지방 3 g 트랜스지방 0g 콜레스테롤 5mg"),
    (2, "원재료: 대두(국산) 98%, 천일염, 응고제(염화마그네슘) 유통기한 별도표기 총 내용량 300g 단백질 9g 지방 5g"),
    (3, "면: 소맥분(밀:미국산), 변성전분, 면류첨가알칼리제(산도조절제) 보관방법 서늘한 곳 나트륨 1,790mg"),
    (4, "내용 없음"),
    (5, None),
]
DICTIONARY = [("구연산", "acid"), ("탄산칼슘", "mineral"), ("산도조절제", "acid"), ("비타민", "vitamin"), ("염화마그네슘", "coagulant")]
SYNONYMS = [("푸른들식품", "푸른들"), ("handrink", "한드링크")]
CORRECTIONS = [("0g", "Og"), ("나트류", "나트륨"), ("Og", "og")]


def _values(rows: list[tuple], *names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({', '.join(names)})"


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "id long, name string, maker string")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "id long, label string")


_NAMES = _values(NAMES, "id", "name", "maker")
# The SQL states its lists and characters itself, so a slip in the library's own shows.
_BASIC = "lower(regexp_replace(coalesce({0}, ''), '[\\s()（）\\[\\]【】,，·•\\-_]+', '', 'g'))"
_STRIPPED = "regexp_replace(regexp_replace(coalesce({0}, ''), '\\(주\\)|주식회사|㈜|유한회사|유한책임회사', '', 'g'), '\\s+', '', 'g')"
_SIZE = "[0-9]+[.,]?[0-9]*\\s*(ml|l|g|kg|oz|리터|밀리리터|그램|킬로그램)"
_PUNCTUATION = "[\\s()（）\\[\\]【】,，·•\\-_×x*+&/]+"
_DEEP = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({{0}}, ''), '\\([^)]*\\)', '', 'g'), '{_SIZE}', '', 'gi'), '(페트|캔|파우치|컵|병|봉지|봉|팩|번들|기획|증정|리필|대용량|미니|멀티팩|세트|묶음|박스)', '', 'g'), '[0-9]+\\s*$', '', 'g'), '{_PUNCTUATION}', '', 'g'))"
_APART = "\\b(페트|캔|파우치|컵|병|봉|봉지|팩|번들|기획|증정|리필|대용량|미니|소용량|멀티팩|세트|묶음|박스|입|개입|PET|CAN)\\b"
_DEEP_WORDS = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({{0}}, ''), '\\([^)]*\\)|（[^）]*）|\\[[^\\]]*\\]|【[^】]*】', '', 'g'), '{_SIZE}', '', 'gi'), '\\s+[0-9]+[.,]?[0-9]*\\s*$', '', 'g'), '{_APART}', '', 'gi'), '{_PUNCTUATION}', '', 'g'))"
_KEY = "lower(regexp_replace(coalesce({0}, ''), '\\s+', '', 'g'))"

# Names for whole tables: each part's name between what names come with.
BEFORE = ["", "[특가] ", "달콤 ", "（신제품）", "미니 파우치 ", "【한정】", "{a} ", "(행사) ", "대용량 ", "Pet ", "㈜"]
BEHIND = ["", " 120g", " 1.5KG 2", " 3개입", " 355 ml x 24캔", " 봉지", " 1,5리터 병", " oz 3", " 2oz", "_PET_ can", " 12.5", "A팩B 세트C", " 500 밀리리터 페트", " (매운맛) 7 "]
MAKERS = ["(주)", "주식회사 ", "유한책임회사", "", "농업회사법인 ", "㈜ "]
BRANCHES = ["", " 제2공장", " 부산지점", " 주식회사", " 협동조합"]


def _pick(words: list[str], n: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][CAST({n} AS INTEGER) % {len(words)} + 1]"


_PART_NAMES = f"(SELECT p_partkey AS id, {_pick(BEFORE, 'p_partkey')} || p_name || {_pick(BEHIND, 'p_partkey')} AS name, {_pick(MAKERS, 'p_partkey')} || p_brand || {_pick(BRANCHES, 'p_partkey')} AS maker FROM part)"


def part_names(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, maker) of all parts, as products are named."""
    pick = lambda words: F.array(*map(F.lit, words))[(F.col("p_partkey") % len(words)).cast("int")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(pick(BEFORE), "p_name", pick(BEHIND)).alias("name"), F.concat(pick(MAKERS), "p_brand", pick(BRANCHES)).alias("maker"))


def _forms_sql(rows: str) -> str:
    forms = {"basic": _BASIC.format("name"), "stripped": _STRIPPED.format("maker"), "deep_form": _DEEP.format("name"), "deep_apart": _DEEP_WORDS.format("name"), "key_form": _KEY.format("name")}
    return f"SELECT CAST(id AS BIGINT) AS id, {', '.join(f'{sql} AS {name}' for name, sql in forms.items())} FROM {rows}"


def _forms(rows: DataFrame) -> DataFrame:
    return rows.select("id", N.product_name(F.col("name")).alias("basic"), N.strip_corporate(F.col("maker")).alias("stripped"), N.deep(F.col("name")).alias("deep_form"), N.deep_words(F.col("name")).alias("deep_apart"), N.key(F.col("name")).alias("key_form"))


@golden("norm_names", _forms_sql(_NAMES))
def norm_names(spark, d):
    return _forms(names(spark))


@query("norm_names_all", _forms_sql(_PART_NAMES))
def norm_names_all(spark, d):
    return _forms(part_names(spark, d))


_MAKER_FORM = """lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\s*(유한책임회사|주식회사|유한회사|합자회사|합명회사|\\(주\\)|㈜)\\s*', '', 'g'), '사회적협동조합|농업회사법인|영농조합법인|협동조합', '', 'g'), '제?[0-9]+공장', '', 'g'), '[가-힣]+공장', '', 'g'), '[가-힣]+지점', '', 'g'), '[가-힣]+센터', '', 'g'), '\\s+', '', 'g'))"""


@query("maker_norm_all", f"""SELECT id, {_MAKER_FORM.format('maker')} AS maker_form,
  lower(regexp_replace(regexp_replace(maker, '\\(주\\)|주식회사|㈜', '', 'g'), '\\s+', '', 'g')) AS simple_form FROM {_PART_NAMES}""")
def maker_norm_all(spark, d):
    return part_names(spark, d).select("id", N.maker(F.col("maker")).alias("maker_form"), N.manufacturer(F.col("maker")).alias("simple_form"))


@golden("maker_norm", "SELECT * FROM (VALUES (1, '푸른들식품', '푸른들식품'), (2, '푸른들식품', '푸른들식품'), (3, 'handrink', '유한회사handrink'), (4, '두레', '농업회사법인두레제2공장'), (5, '', ''), (6, '한끼', '한끼부산공장')) t(id, maker_form, simple_form)")
def maker_norm(spark, d):
    return names(spark).select(F.col("id").cast("int").alias("id"), N.maker(F.col("maker")).alias("maker_form"), N.manufacturer(F.col("maker")).alias("simple_form"))


@golden("canonical_synonym", "SELECT * FROM (VALUES (1, '푸른들'), (2, '푸른들'), (3, '한드링크'), (4, '두레'), (5, ''), (6, '한끼')) t(id, canonical)")
def canonical_synonym(spark, d):
    known = spark.createDataFrame(SYNONYMS, "form string, canonical string")
    rows = names(spark).select(F.col("id").cast("int").alias("id"), N.maker(F.col("maker")).alias("form"))
    return rows.join(known, "form", "left").select("id", F.coalesce("canonical", "form").alias("canonical"))


@golden("norm_names_words", "SELECT * FROM (VALUES (1, '달콤 사과칩 매운맛'), (2, '달콤 사과칩 봉지 1.'), (3, 'cola_zero x 24캔'), (4, '특가 두유 팩 3'), (5, ''), (6, '현미밥')) t(id, words)")
def norm_names_words(spark, d):
    return names(spark).select(F.col("id").cast("int").alias("id"), N.name(F.col("name")).alias("words"))


@golden("deep_words", "SELECT * FROM (VALUES (1, '달콤사과칩'), (2, '달콤사과칩봉지'), (3, 'colazero24캔'), (4, '두유팩'), (5, ''), (6, '현미밥')) t(id, deep_form)")
def deep_words(spark, d):
    return names(spark).select(F.col("id").cast("int").alias("id"), N.deep_words(F.col("name")).alias("deep_form"))


@query("fullwidth_fold", "SELECT p_partkey, lower(replace(p_name, ' ', '')) AS folded FROM part")
def fullwidth_fold(spark, d):
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz"))
    return table(spark, d, "part").select("p_partkey", N.folded_key(wide).alias("folded"))


@query("correct_dictionary", """SELECT p_partkey, replace(replace(replace(p_name, 'ed ', 'ad '), 'ad ring', 'sad ring'), 'old', 'cold') AS fixed,
  CAST(contains(p_name, 'ed ') AS INTEGER) + CAST(contains(replace(p_name, 'ed ', 'ad '), 'ad ring') AS INTEGER) + CAST(contains(replace(replace(p_name, 'ed ', 'ad '), 'ad ring', 'sad ring'), 'old') AS INTEGER) AS n_applied FROM part""")
def correct_dictionary(spark, d):
    fixed, applied = N.corrected(F.col("p_name"), [("ed ", "ad "), ("ad ring", "sad ring"), ("old", "cold")])
    return table(spark, d, "part").select("p_partkey", fixed.alias("fixed"), F.size(applied).alias("n_applied"))


@golden("humanise", "SELECT * FROM (VALUES ('saturated fat is high, sodium_x stays'), ('total fat')) t(label)")
def humanise(spark, d):
    rows = spark.createDataFrame([("sat_fat is high, sodium_x stays",), ("total_fat",)], "c string")
    return rows.select(N.humanised(F.col("c"), {"sat_fat": "saturated fat", "total_fat": "total fat", "sodium": "salt"}).alias("label"))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substring('  ' || {0} || ' ', i, 3)))"
_JACCARD = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))"


@query("trigram_pairs_unblocked", f"""WITH n AS (SELECT DISTINCT p_name AS t FROM part), g AS (SELECT t, {_GRAMS.format('t')} AS s FROM n)
  SELECT a.t AS left_name, b.t AS right_name, {_JACCARD.format('a.s', 'b.s')} AS sim FROM g a, g b WHERE {_JACCARD.format('a.s', 'b.s')} >= 0.5""")
def trigram_pairs_unblocked(spark, d):
    n = table(spark, d, "part").select(F.col("p_name").alias("t")).distinct()
    left, right = (n.select("t", F.col("t").alias(k)) for k in ("left_name", "right_name"))
    return link.trigram_join(left, right, "left_name", "right_name", "t", 0.5)


@query("trigram_pairs_blocked", f"""WITH n AS (SELECT DISTINCT p_name || ' ' || p_type AS t, p_brand AS b FROM part), g AS (SELECT t, b, {_GRAMS.format('t')} AS s FROM n)
  SELECT a.t AS left_name, x.t AS right_name, {_JACCARD.format('a.s', 'x.s')} AS sim FROM g a JOIN g x ON a.b = x.b WHERE {_JACCARD.format('a.s', 'x.s')} >= 0.7""")
def trigram_pairs_blocked(spark, d):
    n = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("t"), F.col("p_brand").alias("b")).distinct()
    left, right = (n.select("t", "b", F.col("t").alias(k)) for k in ("left_name", "right_name"))
    return link.trigram_join(left, right, "left_name", "right_name", "t", 0.7, block="b")


_SEARCH = f"""SELECT p_partkey, p_name, sim FROM (SELECT p_partkey, p_name, {_JACCARD.format('x', 'y')} AS sim FROM (SELECT p_partkey, p_name,
  list_distinct(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS x,
  list_distinct(flatten(list_transform(['cold', 'ring'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS y FROM part))
  WHERE p_name ILIKE '%cold ring%' OR sim >= 0.3 ORDER BY sim DESC, p_name, p_partkey LIMIT 20 OFFSET 5"""


@query("search_trigram", _SEARCH)
def search_trigram(spark, d):
    from labelmill.operators import search

    return search.search(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "cold ring", 20, 5, "p_partkey")


@query("search_stored_index", _SEARCH)
def search_stored_index(spark, d):
    """The same search by a stored index that all parts came to in two appends."""
    part = table(spark, d, "part")
    index = trigram_index.TrigramIndex(spark, f"{shared_dir(spark)}/labelmill/trigrams-{uuid.uuid4().hex}", slots=16)
    for k in range(2):
        index.append(part.where(f"p_partkey % 2 = {k}"), "p_partkey", "p_name", str(k))
    return index.search("cold ring", 20, 5).select(F.col("key").alias("p_partkey"), F.col("name").alias("p_name"), "sim")


@golden("composite_pairs", "SELECT * FROM (VALUES ('콜라 355ml', '(주)한드링크', '콜라 500ml', '한드링크', 0.0), ('콜라 355ml', '(주)한드링크', '콜라 0.355L', '한드링크', 1.0), ('콜라 355ml', '가나', '콜라 355ml', '다라마', 0.0), ('콜라', '', '콜라', '가나', 0.7)) t(n1, m1, n2, m2, score)")
def composite_pairs(spark, d):
    rows = spark.createDataFrame([("콜라 355ml", "(주)한드링크", "콜라 500ml", "한드링크"), ("콜라 355ml", "(주)한드링크", "콜라 0.355L", "한드링크"), ("콜라 355ml", "가나", "콜라 355ml", "다라마"), ("콜라", "", "콜라", "가나")], "n1 string, m1 string, n2 string, m2 string")
    # 0.355L leaves '0.' in the name's normal form; the volumes agree.
    score = S.composite(F.col("n1"), F.col("m1"), F.regexp_replace("n2", "0\\.355L", "355 ml"), F.col("m2"))
    return rows.select("n1", "m1", "n2", "m2", F.round(score, 6).alias("score"))


@query("same_maker", f"""WITH m AS (SELECT DISTINCT p_brand, regexp_replace(maker, '\\s+', '', 'g') AS maker FROM {_PART_NAMES.replace('AS id,', 'AS id, p_brand,')})
  SELECT a.maker AS maker_a, b.maker AS maker_b, a.maker = b.maker OR contains(a.maker, b.maker) OR contains(b.maker, a.maker) AS same FROM m a JOIN m b USING (p_brand)""")
def same_maker(spark, d):
    m = part_names(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id").select("p_brand", F.regexp_replace("maker", "\\s+", "").alias("maker")).distinct()
    pairs = m.withColumnRenamed("maker", "maker_a").join(m.withColumnRenamed("maker", "maker_b"), "p_brand")
    return pairs.select("maker_a", "maker_b", S.same_maker(F.col("maker_a"), F.col("maker_b")).alias("same"))


@query("length_threshold", "SELECT DISTINCT p_name, CASE WHEN length(p_name) <= 8 THEN 0.8 ELSE 0.7 END AS threshold FROM part")
def length_threshold(spark, d):
    return table(spark, d, "part").select("p_name", S.length_threshold(F.col("p_name"), length=8).alias("threshold")).distinct()


@golden("volume_extract", "SELECT * FROM (VALUES (1, '120g', 'g'), (2, '1500g', 'g'), (3, '355ml', 'ml'), (4, '1000ml', 'ml'), (5, NULL, NULL), (6, '210g', 'g')) t(id, volume, family)")
def volume_extract(spark, d):
    return names(spark).select(F.col("id").cast("int").alias("id"), E.volume(F.col("name")).alias("volume"), E.unit_family(F.col("name")).alias("family"))


@golden("number_variants", "SELECT * FROM (VALUES ('12.5g', 12.5, 12.5), ('0', 0.0, NULL), ('', NULL, NULL), ('N/A', NULL, NULL), ('-3', -3.0, -3.0), ('.5%', 0.5, 0.5), (' 7,2', 7.0, 7.0)) t(txt, parsed, parsed_or_null)")
def number_variants(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("12.5g", "0", "", "N/A", "-3", ".5%", " 7,2")], "txt string")
    return rows.select("txt", E.number(F.col("txt")).alias("parsed"), E.number_or_null(F.col("txt")).alias("parsed_or_null"))


@golden("nutrient_regex", "SELECT * FROM (VALUES (1, 155.0, 20.0, 5.5, 2.0, 7.1, 3.0, 0.0, 5.0, 200.0, NULL, 30.0, 'g'), (2, NULL, NULL, NULL, 9.0, 5.0, NULL, NULL, NULL, NULL, NULL, 300.0, 'g'), (3, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1.79, NULL, NULL, NULL), (4, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)) t(id, calories, total_carbs, total_sugars, protein, total_fat, saturated_fat, trans_fat, cholesterol, sodium, dietary_fiber, serving_size, serving_unit)")
def nutrient_regex(spark, d):
    size, unit = E.serving(F.col("label"))
    return labels(spark).select(F.col("id").cast("int").alias("id"), *(c.alias(n) for n, c in E.nutrients(F.col("label")).items()), size.alias("serving_size"), unit.alias("serving_unit"))


@golden("section_extract", "SELECT * FROM (VALUES (1, '밀가루(밀:미국산, 호주산), 설탕 12.5%, 팜유{말레이시아산}, 혼합제제(구연산, 비타민C, 탄산칼슘), 정제소금 함유'), (2, '대두(국산) 98%, 천일염, 응고제(염화마그네슘)'), (3, '소맥분(밀:미국산), 변성전분, 면류첨가알칼리제(산도조절제)'), (4, NULL), (5, NULL)) t(id, section)")
def section_extract(spark, d):
    return labels(spark).select(F.col("id").cast("int").alias("id"), E.ingredient_section(F.col("label")).alias("section"))


@golden("percent_origin", "SELECT * FROM (VALUES (1, 12.5, '밀:미국산, 호주산'), (2, 98.0, '국산'), (3, NULL, '밀:미국산'), (4, NULL, NULL), (5, NULL, NULL)) t(id, percentage, origin)")
def percent_origin(spark, d):
    return labels(spark).select(F.col("id").cast("int").alias("id"), E.percentage(F.col("label")).alias("percentage"), E.origin(F.col("label")).alias("origin"))


@golden("label_items", "SELECT * FROM (VALUES (1, 0, '밀가루', NULL, '밀:미국산, 호주산', ''), (1, 1, '설탕', 12.5, NULL, ''), (1, 2, '팜유', NULL, '말레이시아산', ''), (1, 3, '혼합제제', NULL, NULL, '비타민C|탄산칼슘'), (1, 4, '정제소금', NULL, NULL, ''), (2, 0, '대두', 98.0, '국산', ''), (2, 1, '천일염', NULL, NULL, ''), (2, 2, '응고제', NULL, NULL, ''), (3, 0, '소맥분', NULL, '밀:미국산', ''), (3, 1, '변성전분', NULL, NULL, ''), (3, 2, '면류첨가알칼리제', NULL, NULL, '')) t(id, place, name, percentage, origin, subs)")
def label_items(spark, d):
    items = labels(spark).select(F.col("id").cast("int").alias("id"), F.posexplode(P.parse_label_items(E.ingredient_section(F.col("label")))).alias("place", "item"))
    return items.select("id", "place", "item.name", "item.percentage", "item.origin", F.array_join("item.sub_ingredients", "|").alias("subs"))


@golden("ingredient_tree", "SELECT * FROM (VALUES (1, 0, '밀가루', '밀:미국산|호주산'), (1, 1, '설탕 12.5%', ''), (1, 2, '팜유', '말레이시아산'), (1, 3, '혼합제제', '구연산|비타민C|탄산칼슘'), (1, 4, '정제소금 함유', ''), (2, 0, '대두', '국산'), (2, 1, '98%', ''), (2, 2, '천일염', ''), (2, 3, '응고제', '염화마그네슘'), (3, 0, '소맥분', '밀:미국산'), (3, 1, '변성전분', ''), (3, 2, '면류첨가알칼리제', '산도조절제')) t(id, place, name, subs)")
def ingredient_tree(spark, d):
    tree = labels(spark).select(F.col("id").cast("int").alias("id"), F.posexplode(P.parse_ingredient_tree(E.ingredient_section(F.col("label")))).alias("place", "item"))
    return tree.select("id", "place", "item.name", F.array_join(F.transform("item.sub_ingredients", lambda s: s["name"]), "|").alias("subs"))


_LABEL = "p_name || ' (' || p_brand || ' ' || p_size || '%, ' || p_type || '{0}), 설탕 ' || p_size || '.5%, 분유[알레르기 유발물질: 우유], *표시* 소금' || CASE WHEN p_size % 3 = 0 THEN '(바다) 정제' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ', (산도조절제)' ELSE '' END"


def part_labels(spark: SparkSession, d: str, inside: str = "") -> DataFrame:
    """(id, label) of all parts: ingredient lists with brackets, shares and notes."""
    size = F.col("p_size")
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(" "), size, F.lit("%, "), "p_type", F.lit(f"{inside}), 설탕 "), size, F.lit(".5%, 분유[알레르기 유발물질: 우유], *표시* 소금"), F.when(size % 3 == 0, "(바다) 정제").otherwise(""), F.when(size % 5 == 0, ", (산도조절제)").otherwise(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("label"))


@query("ingredient_tree_all", """WITH r AS (SELECT p_partkey AS id, [{'name': p_name, 'subs': p_brand || '|' || p_type, 'share': CAST(p_size AS DOUBLE)}, {'name': '설탕 ' || p_size || '.5%', 'subs': '', 'share': NULL}, {'name': '분유', 'subs': '', 'share': NULL}] ||
    CASE WHEN p_size % 3 = 0 THEN [{'name': '소금', 'subs': '바다', 'share': NULL}, {'name': '정제', 'subs': '', 'share': NULL}] ELSE [{'name': '소금', 'subs': '', 'share': NULL}] END || CASE WHEN p_size % 5 = 0 THEN [{'name': '산도조절제)', 'subs': '', 'share': NULL}] ELSE [] END AS items FROM part)
  SELECT id, i - 1 AS place, items[i].name AS name, items[i].subs AS subs, items[i].share AS share FROM r, unnest(generate_series(1, len(items))) t(i)""")
def ingredient_tree_all(spark, d):
    # A note in square brackets goes with all that follows up to its end, so what stands behind it stays.
    tree = part_labels(spark, d).select("id", F.posexplode(P.parse_ingredient_tree(F.col("label"))).alias("place", "item"))
    return tree.select("id", F.col("place").cast("long").alias("place"), "item.name", F.array_join(F.transform("item.sub_ingredients", lambda s: s["name"]), "|").alias("subs"), F.get("item.sub_ingredients", F.lit(0))["percentage"].alias("share"))


@query("label_items_all", """WITH r AS (SELECT p_partkey AS id, [{'name': p_name, 'detail': p_brand || ' ' || p_size || '%, ' || p_type, 'share': CAST(p_size AS DOUBLE), 'subs': regexp_extract(p_brand, '^[^0-9]+') || '|' || p_type}, {'name': '설탕', 'detail': '', 'share': p_size + 0.5, 'subs': ''}, {'name': '분유', 'detail': '', 'share': NULL, 'subs': ''}] ||
    [{'name': '*표시* 소금', 'detail': CASE WHEN p_size % 3 = 0 THEN '바다' ELSE '' END, 'share': NULL, 'subs': ''}] || CASE WHEN p_size % 5 = 0 THEN [{'name': '(산도조절제)', 'detail': '산도조절제', 'share': NULL, 'subs': ''}] ELSE [] END AS items FROM part)
  SELECT id, i - 1 AS place, items[i].name AS name, items[i].detail AS detail, items[i].share AS share, items[i].subs AS subs FROM r, unnest(generate_series(1, len(items))) t(i)""")
def label_items_all(spark, d):
    items = part_labels(spark, d).select("id", F.posexplode(P.parse_label_items(F.col("label"))).alias("place", "item"))
    return items.select("id", F.col("place").cast("long").alias("place"), "item.name", "item.detail", F.col("item.percentage").alias("share"), F.array_join("item.sub_ingredients", "|").alias("subs"))


@query("additives_all", """SELECT p_partkey AS id, name, category, match_type FROM part, LATERAL (SELECT '산도조절제' AS name, 'acid' AS category, 'exact(main)' AS match_type WHERE false UNION ALL
  SELECT '비타민', 'vitamin', 'partial(sub)' UNION ALL SELECT '구연산', 'acid', 'detail_scan' UNION ALL SELECT '산도조절제', 'acid', 'partial(main)' WHERE p_size % 5 = 0)""")
def additives_all(spark, d):
    rows = part_labels(spark, d, ", 비타민C, 구연산").select("id", F.explode(P.identify_additives(DICTIONARY)(F.col("label"))).alias("a"))
    return rows.select("id", "a.name", "a.category", "a.match_type")


@golden("ingredient_explode", "SELECT * FROM (VALUES (2, '대두'), (2, '국산'), (2, '98%'), (2, '천일염'), (2, '응고제'), (2, '염화마그네슘'), (3, '소맥분'), (3, '밀:미국산'), (3, '변성전분'), (3, '면류첨가알칼리제'), (3, '산도조절제')) t(id, name)")
def ingredient_explode(spark, d):
    rows = labels(spark).where("id IN (2, 3)").select(F.col("id").cast("int").alias("id"), P.parse_ingredient_tree(E.ingredient_section(F.col("label"))).alias("tree"))
    return rows.select("id", F.explode(P.ingredient_names(F.col("tree"))).alias("name"))


@golden("additive_identify", "SELECT * FROM (VALUES (1, '비타민', 'vitamin', 'partial(sub)'), (1, '탄산칼슘', 'mineral', 'exact(sub)'), (1, '구연산', 'acid', 'detail_scan'), (2, '염화마그네슘', 'coagulant', 'detail_scan'), (3, '산도조절제', 'acid', 'detail_scan')) t(id, name, category, match_type)")
def additive_identify(spark, d):
    found = labels(spark).select(F.col("id").cast("int").alias("id"), F.explode(P.identify_additives(DICTIONARY)(E.ingredient_section(F.col("label")))).alias("a"))
    return found.select("id", "a.name", "a.category", "a.match_type")


@golden("allergen_groups", "SELECT * FROM (VALUES (1, '밀'), (2, '대두'), (3, '밀'), (4, ''), (5, '')) t(id, allergens)")
def allergen_groups(spark, d):
    return labels(spark).select(F.col("id").cast("int").alias("id"), F.array_join(E.allergens(F.col("label")), ",").alias("allergens"))


@query("keyword_groups", "SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(text, 'the') THEN 'english' END, CASE WHEN contains(text, 'eau') OR contains(text, 'ment') THEN 'french' END, CASE WHEN contains(text, 'keit') THEN 'german' END], lambda x: x IS NOT NULL)), ',') AS hits FROM documents")
def keyword_groups(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(E.groups_named(F.col("text"), {"english": ["the"], "french": ["eau", "ment"], "german": ["keit"]}), ",").alias("hits"))


@query("dict_containment", "SELECT doc_id, w AS word FROM documents, (SELECT unnest(['idiot', 'License', 'keit', 'zzz']) AS w) WHERE contains(text, w)")
def dict_containment(spark, d):
    words = spark.createDataFrame([("idiot",), ("License",), ("keit",), ("zzz",)], "word string")
    return link.dictionary_hits(table(spark, d, "documents").select("doc_id", "text"), words, "doc_id", "text", "word")


@query("dict_containment_all", """WITH w AS (SELECT DISTINCT substring(x, 1, 1 + length(x) % 7) AS w FROM (SELECT unnest(string_split(text, ' ')) AS x FROM benchmark UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) WHERE x <> '')
  SELECT p_partkey, w AS word FROM part, w WHERE contains(p_name || ' ' || p_type, w)""")
def dict_containment_all(spark, d):
    """A dictionary of thousands of words of one to seven characters, looked up in every part."""
    p = table(spark, d, "part")
    stems = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("x")).unionByName(p.select(F.explode(F.split("p_name", " ")).alias("x")))
    words = stems.where("x != ''").select(F.substring("x", F.lit(1), 1 + F.length("x") % 7).alias("word")).distinct()
    return link.dictionary_hits(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), words, "p_partkey", "text", "word")


@query("dict_exact_exploded", """SELECT n.w AS word, count(*) AS n, max(k.nation) AS nation FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) n
  JOIN (SELECT w, max_by(n_name, n_nationkey) AS nation FROM (SELECT ['red', 'blue', 'cold'][n_nationkey % 3 + 1] AS w, n_name, n_nationkey FROM nation) GROUP BY w) k ON n.w = k.w GROUP BY n.w""")
def dict_exact_exploded(spark, d):
    words = F.array(F.lit("red"), F.lit("blue"), F.lit("cold"))
    entries = table(spark, d, "nation").select(words[F.col("n_nationkey") % 3].alias("entry"), F.col("n_name").alias("nation"), "n_nationkey")
    found = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return link.exact_hits(found, entries, "word", "entry", F.col("n_nationkey")).groupBy("word").agg(F.count("*").alias("n"), F.max("nation").alias("nation"))


@query("substring_join", "SELECT DISTINCT b.w AS needle, p.p_name AS hay FROM (SELECT DISTINCT unnest(string_split(p_name, ' ') || [substring(p_name, 2, 2), substring(p_name, 3, 1)]) AS w FROM part) b JOIN (SELECT DISTINCT p_name FROM part) p ON contains(p.p_name, b.w)")
def substring_join(spark, d):
    p = table(spark, d, "part")
    needles = F.concat(F.split("p_name", " "), F.array(F.substring("p_name", 2, 2), F.substring("p_name", 3, 1)))
    return link.substring_join(p.select(F.explode(needles).alias("needle")), p.select(F.col("p_name").alias("hay")), "needle", "hay")


@query("keyword_lookup_priority", """WITH k AS (SELECT unnest(['RING', 'bolt', 'unknown']) AS keyword)
  SELECT keyword, p_partkey FROM k LEFT JOIN LATERAL (SELECT p_partkey FROM part WHERE contains(lower(p_name), lower(keyword)) ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, length(p_name), p_partkey LIMIT 1) ON true""")
def keyword_lookup_priority(spark, d):
    k = spark.createDataFrame([("RING",), ("bolt",), ("unknown",)], "keyword string")
    order = [F.when(F.col("p_size") > 40, 0).otherwise(1), F.length("p_name"), F.col("p_partkey")]
    return quality.keyword_lookup(k, table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_name", order).select("keyword", "p_partkey")


@query("longest_prefix", "SELECT DISTINCT p_name, CASE WHEN starts_with(p_name, 'cold wi') THEN 7 WHEN starts_with(p_name, 'cold') THEN 4 WHEN starts_with(p_name, 're') THEN 2 ELSE 0 END AS prefix_length FROM part")
def longest_prefix(spark, d):
    p = table(spark, d, "part").select("p_name").distinct()
    return p.select("p_name", quality.longest_prefix(p, "p_name", ["re", "cold", "cold wi", "zz"]).alias("prefix_length"))
