"""Thresholds and keyword rules of the scorer, as plain data and as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Daily values, cut-offs and limits of the colour rules.
DAILY_VALUES = {"calories": 2000.0, "total_fat": 54.0, "sat_fat": 15.0, "cholesterol": 300.0, "sodium": 2000.0, "sugars": 100.0, "fiber": 25.0, "protein": 55.0}
NEGATIVE_PCT = {n: (10.0, 25.0) for n in ("sodium", "sugars", "sat_fat", "total_fat", "cholesterol")}
PER_100G = {"sodium": (120.0, 600.0), "sugars": (5.0, 15.0), "sat_fat": (1.5, 5.0), "total_fat": (3.0, 17.5)}
PER_100ML = {"sodium": (50.0, 250.0), "sugars": (2.5, 6.3), "sat_fat": (0.75, 2.5), "total_fat": (1.5, 8.75)}
POSITIVE_PCT = {n: (5.0, 15.0) for n in ("protein", "fiber")}
TRANS_FAT = (0.0, 0.5)
SANITY_LIMITS = {
    "calories": (2000.0, 900.0),
    "sodium": (5000.0, 40000.0),
    "sugars": (200.0, 100.0),
    "total_fat": (200.0, 100.0),
    "sat_fat": (100.0, 100.0),
    "protein": (200.0, 100.0),
    "cholesterol": (2000.0, None),
    "trans_fat": (50.0, 100.0),
    "fiber": (100.0, 100.0),
}
MASS_BALANCE, CALORIE_DEVIATION = 1.1, 0.3

# Words of food types and names that decide the scoring category, in order.
TYPE_RULES = [
    ("alcohol", ["주류", "맥주", "소주", "와인", "위스키", "탁주"]),
    ("supplement", ["건강기능식품", "영양보충용식품"]),
    ("fermented", ["김치류", "장류", "발효유류", "발효식품"]),
    ("beverage", ["음료류", "탄산음료", "과·채주스", "두유류", "커피", "차류", "혼합음료", "과채음료"]),
    ("dried", ["육포", "건포류", "건과류", "김류", "장류"]),
]
NOT_BEVERAGE_TYPES = ["유지류", "식용유지", "올리브유", "참기름", "들기름", "식초", "소스류", "드레싱", "액상차"]
NAME_RULES = [
    ("fermented", ["김치", "된장", "간장", "젓갈", "청국장", "고추장"]),
    ("beverage", ["음료", "주스", "워터", "우유", "두유", "커피", "콜라", "사이다", "에이드"]),
    ("dried", ["육포", "말린", "건조", "분말", "가루", "건과", "누룽지", "미역", "다시마"]),
]
EXCLUDED = ("alcohol", "supplement", "raw_ingredient")

# The thirteen context categories with their words, in order.
CONTEXT_RULES = [
    ("alcohol", ["주류", "맥주", "소주", "청주", "와인", "위스키", "막걸리", "탁주", "발효주", "리큐르", "증류주"]),
    ("health_functional", ["건강기능식품", "영양보충용", "비타민제", "무기질제"]),
    ("raw_ingredient", ["원료", "농산물", "축산물", "수산물", "생식", "신선식품"]),
    ("fermented", ["김치", "깍두기", "장류", "된장", "고추장", "간장", "청국장", "쌈장", "젓갈", "식초", "발효유", "요거트", "낫토", "치즈"]),
    ("beverage", ["음료", "탄산음료", "주스", "두유", "차", "커피", "워터", "음용수", "액상차", "식혜", "식이음료", "에너지음료", "이온음료"]),
    ("dried", ["건조", "건과", "말린", "분말", "가루", "동결건조", "농축", "진액", "엑기스", "김 ", "김(", "미역", "다시마", "육포", "북어", "건어물"]),
    ("nuts", ["견과", "땅콩", "아몬드", "호두", "캐슈너트", "피스타치오", "잣", "해바라기씨", "호박씨"]),
    ("dairy", ["우유", "유제품", "아이스크림", "연유", "분유"]),
    ("juice", ["과·채주스", "과채주스", "천연과즙", "100%주스"]),
    ("whole_grain", ["통밀", "현미", "귀리", "오트밀", "잡곡", "통곡"]),
    ("sauce", ["소스", "드레싱", "마요네즈", "케첩", "머스타드", "카레", "양념", "복합조미식품", "향신료"]),
    ("soup", ["국", "찌개", "탕", "죽", "스프", "수프"]),
]
CONTEXT_LABELS = {
    "general": "일반 가공식품",
    "beverage": "음료",
    "fermented": "발효식품",
    "dried": "건조·농축식품",
    "nuts": "견과류",
    "dairy": "유제품",
    "juice": "과일주스",
    "whole_grain": "통곡물",
    "sauce": "소스·양념류",
    "soup": "국·찌개",
    "alcohol": "주류",
    "health_functional": "건강기능식품",
    "raw_ingredient": "원료식품",
}
CONTEXT_EXCLUDED = ("alcohol", "health_functional", "raw_ingredient")

# What is said of a context category (id, icon, title, body), of a scored product, and of a printed zero.
CONTEXT_MESSAGES = {
    "beverage": ("beverage_per_100ml", "🥤", "음료 안내", "100mL 기준으로 평가됩니다."),
    "fermented": ("fermented_sodium_context", "🥬", "발효식품 맥락", "발효식품은 나트륨이 높으나 유산균과 식이섬유가 풍부합니다."),
    "dried": ("dried_per_serving_only", "🍂", "건조식품 안내", "건조식품으로 100g당 수치가 높게 표시됩니다. 1회 제공량 기준만 적용했습니다."),
    "nuts": ("nuts_healthy_fat", "🥜", "견과류 맥락", "지방이 높지만 불포화지방산이 풍부한 건강한 지방입니다."),
    "dairy": ("dairy_calcium", "🥛", "유제품 맥락", "포화지방이 있으나 칼슘과 단백질의 주요 공급원입니다."),
    "juice": ("juice_natural_sugar", "🍹", "과일주스 맥락", "천연 과당이 포함되어 당류가 높게 표시됩니다. 첨가당과 구분하세요."),
    "whole_grain": ("whole_grain_fiber", "🌾", "통곡물 맥락", "탄수화물이 높지만 식이섬유와 미네랄이 풍부합니다."),
    "sauce": ("sauce_small_serving", "🥫", "양념류 안내", "양념류는 1회 사용량이 적으므로 실제 섭취 나트륨은 표시보다 낮을 수 있습니다."),
    "soup": ("soup_broth_amount", "🍜", "국물류 안내", "표시 나트륨은 국물 전량 기준입니다. 국물을 적게 드시면 줄일 수 있습니다."),
    "alcohol": ("alcohol_excluded", "🍺", "평가 대상 외", "주류는 영양 신호등 평가 대상이 아닙니다."),
    "health_functional": ("health_functional_excluded", "💊", "평가 대상 외", "건강기능식품은 별도 기준이 적용됩니다."),
    "raw_ingredient": ("raw_excluded", "🥩", "평가 대상 외", "미가공 원료식품은 영양 신호등을 적용하지 않습니다."),
}
SCORE_MESSAGES = {
    "dried": "건조식품으로 100g당 수치가 높게 표시됩니다. 1회 제공량 기준으로 판정하였습니다.",
    "fermented": "발효식품은 나트륨이 높으나, 유산균·식이섬유 등 건강 유익 성분이 함께 포함되어 있습니다.",
    "nuts": "지방 함량이 높지만, 불포화지방산이 풍부한 건강한 지방입니다.",
}
ZERO_TRANS_FAT = "식약처 규정에 따라 0.2g 미만은 0g으로 표시될 수 있습니다."
SERVINGS_MESSAGE = "이 제품은 {0}회분입니다. 전량 섭취 시 수치가 {0}배가 됩니다."

# What a product's text card says, in its order.
EXCLUDED_SAID = {
    "alcohol": "주류는 영양 신호등 평가 대상이 아닙니다.",
    "supplement": "건강기능식품은 별도 기준이 적용됩니다.",
    "raw_ingredient": "원료 식품은 영양성분표가 부착되지 않는 미가공 제품입니다.",
}
EXCLUDED_OTHERWISE = "평가 대상 외"
CARD_NUTRIENTS = {"sodium": "나트륨", "sugars": "당류", "sat_fat": "포화지방", "total_fat": "지방", "cholesterol": "콜레스테롤", "protein": "단백질", "fiber": "식이섬유", "trans_fat": "트랜스지방"}
CARD_COLORS = {"green": "🟢", "yellow": "🟡", "red": "🔴", "gray": "⚪"}
CARD_WIDTH, CARD_PADDING = 6, "\u3000"

COLOR_RANK = {"green": 1, "yellow": 2, "orange": 3, "red": 4}


def thresholds_as_of(config: DataFrame, as_of: str, profile: str = "adult") -> DataFrame:
    """(nutrient, threshold, basis, value): those valid on a day, the profile's own over the adult ones.

    ``config`` has nutrient, threshold, basis, value, profile, effective_from, effective_to (null:
    open). Of several valid rows of one profile the one that began last counts.
    """
    day = F.to_date(F.lit(as_of))
    valid = config.where((F.col("effective_from") <= day) & (F.coalesce("effective_to", F.lit("9999-12-31").cast("date")) >= day) & F.col("profile").isin(profile, "adult"))
    order = F.struct((F.col("profile") == profile).cast("int"), "effective_from", "value")
    return valid.groupBy("nutrient", "threshold", "basis").agg(F.max_by("value", order).alias("value"))


def threshold_table(spark: SparkSession) -> DataFrame:
    """The built-in cut-offs as (nutrient, basis, low, high) rows."""
    rows = [(n, b, *v) for b, rules in (("pct_dv", NEGATIVE_PCT), ("per_100g", PER_100G), ("per_100ml", PER_100ML), ("positive", POSITIVE_PCT)) for n, v in rules.items()]
    return spark.createDataFrame(rows, "nutrient string, basis string, low double, high double")
