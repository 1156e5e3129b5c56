"""Values out of label text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label words of nutrients with the unit that follows the number.
NUTRIENT_PATTERNS = {
    "calories": "열량[:\\s]*(\\d+[.,]?\\d*)\\s*(?:kcal|킬로칼로리|Kcal)",
    "total_carbs": "탄수화물[:\\s]*(\\d+[.,]?\\d*)\\s*g",
    "total_sugars": "당류[:\\s]*(\\d+[.,]?\\d*)\\s*g",
    "protein": "단백질[:\\s]*(\\d+[.,]?\\d*)\\s*g",
    "total_fat": "(?<!포화)(?<!트랜스)지방[:\\s]*(\\d+[.,]?\\d*)\\s*g",
    "saturated_fat": "포화지방(?:산)?[:\\s]*(\\d+[.,]?\\d*)\\s*g",
    "trans_fat": "트랜스지방(?:산)?[:\\s]*(\\d+[.,]?\\d*)\\s*g",
    "cholesterol": "콜레스테롤[:\\s]*(\\d+[.,]?\\d*)\\s*m?g",
    "sodium": "나트륨[:\\s]*(\\d+[.,]?\\d*)\\s*m?g",
    "dietary_fiber": "식이섬유[:\\s]*(\\d+[.,]?\\d*)\\s*g",
}
# What a serving, the ingredient section, its end, bullets and allergens look like on a label.
SERVING_PATTERN = "(?:1회\\s*제공량|총\\s*내용량)[:\\s]*(\\d+[.,]?\\d*)\\s*(g|ml|mL|kg|L)"
SECTION_END = "(?=영양(?:정보|성분)|유통기한|보관방법|내용량|포장재질|품목보고|※|주의사항|직사광선|부정\\s*[·.]|반품|고객상담|업소명|제조원|판매원|\\d{10,})"
SECTION_STARTS = ["원재료명\\s*(?:및\\s*)?(?:함량)?\\s*[:\\s]\\s*", "원재료명\\s*", "원재료\\s*[:\\s]\\s*", "\\*?면\\s*[:]\\s*"]
BULLETS = "[●▶■□◆◇▷▸•·|]"
ALLERGENS = {
    "난류": ["계란", "달걀", "난백", "난황", "마요네즈", "리소자임"],
    "우유": ["우유", "탈지분유", "유청", "카제인", "락토스", "버터", "치즈", "크림", "유단백"],
    "밀": ["밀가루", "소맥분", "글루텐"],
    "대두": ["대두", "두부", "간장", "된장", "콩기름", "레시틴"],
    "땅콩": ["땅콩", "피넛"],
    "메밀": ["메밀", "소바"],
    "게": ["게살", "크래미", "꽃게"],
    "새우": ["새우", "건새우", "새우젓"],
    "돼지고기": ["돼지고기", "베이컨", "돈지"],
    "복숭아": ["복숭아", "황도"],
    "토마토": ["토마토", "케첩"],
    "호두": ["호두"],
    "닭고기": ["닭고기", "닭가슴살", "치킨"],
    "쇠고기": ["쇠고기", "소고기", "젤라틴", "쇠고기엑기스"],
    "오징어": ["오징어"],
    "조개류": ["굴", "홍합", "전복", "조개", "바지락"],
    "아황산류": ["아황산", "이산화황"],
}


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def decimal(c: Column) -> Column:
    """A number that may have a decimal comma; null if it is none."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def number(c: Column) -> Column:
    """The number that a text begins with ('12.5g' gives 12.5); null for others, '' and 'N/A'."""
    return _group(c, "^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+))").try_cast("double")


def number_or_null(c: Column) -> Column:
    """As ``number``, but 0 counts as missing, as in some loaders."""
    return F.nullif(number(c), F.lit(0.0))


def volume(c: Column) -> Column:
    """The first quantity as '355ml' or '1500g': litres as ml, kg as g; null if none."""
    pattern = "(\\d+[.,]?\\d*)\\s*((?i)ml|kg|l|g)"
    value, unit = decimal(_group(c, pattern, 1)), F.lower(_group(c, pattern, 2))
    scaled = F.when(unit.isin("l", "kg"), value * 1000).otherwise(value)
    whole = F.when(scaled == F.floor(scaled), F.floor(scaled).cast("string")).otherwise(scaled.cast("string"))
    return F.concat(whole, F.when(unit.isin("l", "ml"), F.lit("ml")).otherwise(F.lit("g")))


def unit_family(c: Column) -> Column:
    """'ml' or 'g' of the first quantity; null if none."""
    unit = F.lower(_group(c, "\\d+[.,]?\\d*\\s*((?i)ml|kg|l|g)"))
    return F.when(unit.isin("l", "ml"), F.lit("ml")).when(unit.isin("g", "kg"), F.lit("g"))


def percentage(c: Column) -> Column:
    return decimal(_group(c, "(\\d+[.,]?\\d*)\\s*%"))


def origin(c: Column) -> Column:
    """The bracketed text that ends in 산 ('made in')."""
    return _group(c, "[(（]([^)）]*산)[)）]")


def nutrients(c: Column) -> dict[str, Column]:
    """A column for each nutrient that a label states."""
    return {n: decimal(_group(c, p)) for n, p in NUTRIENT_PATTERNS.items()}


def serving(c: Column) -> tuple[Column, Column]:
    """Size and unit of the serving or the content, whichever comes first."""
    return decimal(_group(c, SERVING_PATTERN, 1)), F.lower(_group(c, SERVING_PATTERN, 2))


def ingredient_section(c: Column, least: int = 10) -> Column:
    """The ingredient part of a label: the first of four openings that gives at least ``least`` characters."""
    clean = F.regexp_replace(c, BULLETS, " ")
    found = [F.trim(F.regexp_extract(clean, f"(?s){start}(.+?){SECTION_END}", 1)) for start in SECTION_STARTS]
    return F.coalesce(*(F.when(F.length(x) >= least, x) for x in found))


def groups_named(c: Column, groups: dict[str, list[str]]) -> Column:
    """Sorted names of the keyword groups of which any keyword is in the text."""
    text = F.coalesce(c, F.lit(""))
    hit = [F.when(F.exists(F.array(*(F.lit(k) for k in words)), lambda k: F.contains(text, k)), F.lit(name)) for name, words in groups.items()]
    return F.array_sort(F.array_compact(F.array(*hit)))


def allergens(c: Column) -> Column:
    return groups_named(c, ALLERGENS)


def capped(c: Column, most: int | None = None) -> Column:
    """Label text up to a length that a service may set for what it takes; by default all of it."""
    return c if most is None else F.substring(c, 1, most)
