"""The colour scorer: wide column expressions over one row per product, so nothing is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators import rules as R

NEGATIVE = list(R.NEGATIVE_PCT)
POSITIVE = list(R.POSITIVE_PCT)
#: Begins the names of columns that only stand between projections.
_OWN = "scored_from_"


def rounded(c: Column, digits: int) -> Column:
    """Half up, as floor(x * 10^k + 0.5) / 10^k."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def _has(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def food_category(food_type: Column, unit: Column, name: Column, seaweed: bool = True, type_rules=R.TYPE_RULES, name_rules=R.NAME_RULES, not_beverage=R.NOT_BEVERAGE_TYPES) -> Column:
    """Scoring category: by food type, then by a liquid unit, then by name, else general.

    With seaweed, a name with 김 that isn't kimchi or gimbap is dried.
    """
    kind, liquid, title = F.coalesce(food_type, F.lit("")), F.lower(F.coalesce(unit, F.lit(""))).isin("ml", "l"), F.coalesce(name, F.lit(""))
    found = F.when(F.lit(False), F.lit(""))
    for category, words in type_rules:
        found = found.when(_has(kind, words), F.lit(category))
    found = found.when(liquid & ~_has(kind, not_beverage), F.lit("beverage"))
    for category, words in name_rules:
        found = found.when(_has(title, words), F.lit(category))
    if seaweed:
        found = found.when(title.rlike("김([^치밥]|$)"), F.lit("dried"))
    return found.otherwise(F.lit("general"))


def context(food_type: Column, rules=R.CONTEXT_RULES) -> dict[str, Column]:
    """Context columns of a food type: category, label, excluded, reason, dried, beverage, how it was found,
    and messages, an array of (id, icon, title, body, severity)."""
    kind = F.trim(F.coalesce(food_type, F.lit("")))
    found = F.when(kind == "", F.lit("general"))
    for category, words in rules:
        found = found.when(_has(kind, words), F.lit(category))
    category = found.otherwise(F.lit("general"))
    labels = F.create_map(*(F.lit(x) for kv in R.CONTEXT_LABELS.items() for x in kv))
    out = category.isin(*R.CONTEXT_EXCLUDED)
    said = F.create_map(*(x for k, (i, icon, title, body) in R.CONTEXT_MESSAGES.items() for x in (F.lit(k), F.struct(*(F.lit(v).alias(n) for n, v in (("id", i), ("icon", icon), ("title", title), ("body", body), ("severity", "info")))))))
    return {
        "category": category,
        "category_label": labels[category],
        "is_excluded": out,
        "exclude_reason": F.when(out, category),
        "is_dried_exception": category == "dried",
        "is_beverage": category.isin("beverage", "juice"),
        "detection_method": F.when(kind == "", F.lit("silent_fallback")).otherwise(F.lit("c005_food_type")),
        "messages": F.array_compact(F.array(said[category])),
    }


def judge_limit(value: Column, low: float, high: float) -> Column:
    """green up to low, yellow up to high, else red; null stays null."""
    return F.when(value <= low, F.lit("green")).when(value <= high, F.lit("yellow")).when(value.isNotNull(), F.lit("red"))


def judge_positive(value: Column, gray: float, green: float) -> Column:
    """gray below the first limit, green from the second on, else yellow; null stays null."""
    return F.when(value < gray, F.lit("gray")).when(value >= green, F.lit("green")).when(value.isNotNull(), F.lit("yellow"))


def color_rank(c: Column) -> Column:
    return F.when(c == "green", F.lit(1)).when(c == "yellow", F.lit(2)).when(c == "orange", F.lit(3)).when(c == "red", F.lit(4))


def rank_color(c: Column) -> Column:
    return F.when(c == 1, F.lit("green")).when(c == 2, F.lit("yellow")).when(c == 3, F.lit("orange")).when(c == 4, F.lit("red"))


def worse(a: Column, b: Column) -> Column:
    """The worse of two colours; one alone if the other is null."""
    return rank_color(F.greatest(color_rank(a), color_rank(b)))


def pct_dv(amount: Column, nutrient: str) -> Column:
    return amount / R.DAILY_VALUES[nutrient] * 100


def per_100(amount: Column, serving: Column) -> Column:
    return amount / F.nullif(serving, F.lit(0.0)) * 100


def evaluate(df: DataFrame, category: Column | None = None, default_serving: float | None = 100.0, excluded=R.EXCLUDED) -> DataFrame:
    """df with the scoring columns.

    df has food_type, content_unit, product_name, serving_size, total_content and a double
    column for each nutrient (calories, sodium, sugars, sat_fat, total_fat, cholesterol,
    protein, fiber, trans_fat), all nullable. Adds food_category, is_excluded, is_dried,
    <nutrient>_color, _pct_dv, _per_100 and _basis, trans_fat_color, calories_pct_dv,
    servings_per_container, exclude_reason, context_messages (what is said of the category),
    trans_fat_note (of a printed zero) and servings_message. Excluded categories get nulls; a missing nutrient too. A serving size
    of 0 or null counts as ``default_serving``; with None the absolute basis is left out then.
    """
    kind = food_category(F.col("food_type"), F.col("content_unit"), F.col("product_name")) if category is None else category
    base = df.withColumns({"food_category": kind}).withColumns({"is_excluded": F.col("food_category").isin(*excluded), "is_dried": F.col("food_category") == "dried"})
    counts, drink, dried = ~F.col("is_excluded"), F.col("food_category") == "beverage", F.col("is_dried")
    size = F.nullif(F.col("serving_size").cast("double"), F.lit(0.0))
    if default_serving is not None:
        size = F.coalesce(size, F.lit(default_serving))
    # What several columns are made of stands in projections of its own, so that it is worked out, and compiled, once.
    limits = lambda x, low, high: F.when(x <= low, F.lit(1)).when(x <= high, F.lit(2)).when(x.isNotNull(), F.lit(4))
    servings = rounded(F.col("total_content") / F.nullif(F.col("serving_size").cast("double"), F.lit(0.0)), 1)
    amounts = {f"{_OWN}servings": F.when(counts & (F.col("total_content") > F.col("serving_size")) & (servings > 1), servings)}
    for n in NEGATIVE:
        amounts[f"{_OWN}{n}_share"] = F.when(counts, pct_dv(F.col(n), n))
        if n in R.PER_100G:
            amounts[f"{_OWN}{n}_per"] = F.when(counts & ~dried, per_100(F.col(n), size))
    amounts |= {f"{_OWN}{n}_share": F.when(counts, pct_dv(F.col(n), n)) for n in POSITIVE}
    ranks: dict[str, Column] = {}
    for n in NEGATIVE:
        ranks[f"{_OWN}{n}_by_share"] = limits(F.col(f"{_OWN}{n}_share"), *R.NEGATIVE_PCT[n])
        if n in R.PER_100G:
            per = F.col(f"{_OWN}{n}_per")
            ranks[f"{_OWN}{n}_by_weight"] = F.when(drink, limits(per, *R.PER_100ML[n])).otherwise(limits(per, *R.PER_100G[n]))
    new: dict[str, Column] = {}
    for n in NEGATIVE:
        share, by_share = F.col(f"{_OWN}{n}_share"), F.col(f"{_OWN}{n}_by_share")
        per, by_weight = (F.col(f"{_OWN}{n}_per"), F.col(f"{_OWN}{n}_by_weight")) if n in R.PER_100G else (F.lit(None).cast("double"), None)
        weighs = F.lit(False) if by_weight is None else F.coalesce(by_weight > by_share, F.lit(False))
        new |= {
            f"{n}_color": rank_color(by_share if by_weight is None else F.greatest(by_share, by_weight)),
            f"{n}_pct_dv": rounded(share, 1),
            f"{n}_per_100": rounded(per, 2),
            f"{n}_basis": F.when(share.isNull(), F.lit(None)).when(weighs & drink, F.lit("per_100ml")).when(weighs, F.lit("per_100g")).otherwise(F.lit("pct_dv")),
        }
    for n in POSITIVE:
        share = F.col(f"{_OWN}{n}_share")
        new |= {f"{n}_color": judge_positive(share, *R.POSITIVE_PCT[n]), f"{n}_pct_dv": rounded(share, 1)}
    new["trans_fat_color"] = judge_limit(F.when(counts, F.col("trans_fat")), *R.TRANS_FAT)
    new["calories_pct_dv"] = rounded(pct_dv(F.when(counts, F.col("calories")), "calories"), 1)
    servings = F.col(f"{_OWN}servings")
    count = F.when(servings == F.floor(servings), F.floor(servings).cast("string")).otherwise(servings.cast("string"))
    said = F.create_map(*(F.lit(x) for kv in R.SCORE_MESSAGES.items() for x in kv))
    new |= {
        "servings_per_container": servings,
        "exclude_reason": F.when(~counts, F.col("food_category")),
        "context_messages": F.when(counts, F.array_compact(F.array(said[F.col("food_category")]))),
        "trans_fat_note": F.when(counts & (F.col("trans_fat") == 0), F.lit(R.ZERO_TRANS_FAT)),
        "servings_message": F.when(servings.isNotNull(), F.replace(F.lit(R.SERVINGS_MESSAGE), F.lit("{0}"), count)),
    }
    return base.withColumns(amounts).withColumns(ranks).withColumns(new).drop(*amounts, *ranks)


def _shown(c: Column) -> Column:
    """A number as text, without zeros behind its last decimal."""
    return F.coalesce(F.regexp_replace(c.try_cast("decimal(38,2)").cast("string"), r"\.?0+$", ""), c.cast("string"))


def text_card(warnings: Column | None = None) -> Column:
    """A product scored by ``evaluate`` as text, one line for each thing that is said of it.

    An excluded product is one line with its reason. warnings, an array of ``sanity_warnings``,
    come last; a null array, like an empty one, adds nothing. A null name shows as nothing.
    """
    name, bar = F.coalesce("product_name", F.lit("")), F.lit("│")
    icons, reasons = (F.create_map(*(F.lit(x) for kv in said.items() for x in kv)) for said in (R.CARD_COLORS, R.EXCLUDED_SAID))
    known = lambda before, c, after="": F.when(c.isNotNull(), F.concat(F.lit(before), c, F.lit(after)))
    lines = [
        F.concat(F.lit("┌─── "), name, F.lit(" ───")),
        F.concat(F.lit("│  카테고리: "), "food_category", F.when(F.col("is_dried"), F.lit(" (건조식품 예외 적용)")).otherwise("")),
        bar,
        F.when(F.col("calories").isNotNull(), F.concat(F.lit("│  열량      "), _shown(F.col("calories")), F.lit("kcal   "), _shown(F.col("calories_pct_dv")), F.lit("%"))),
    ]
    for n, title in R.CARD_NUTRIENTS.items():
        share = F.lit("") if n == "trans_fat" else F.coalesce(known("", _shown(F.col(f"{n}_pct_dv")), "%"), F.lit(""))
        weight = F.coalesce(known(" (100g: ", _shown(F.col(f"{n}_per_100")), ")"), F.lit("")) if n in NEGATIVE else F.lit("")
        basis = F.col(f"{n}_basis") if n in NEGATIVE else F.lit("absolute" if n == "trans_fat" else "pct_dv")
        judged = F.concat(F.coalesce(icons[F.col(f"{n}_color")], F.lit("❓")), F.lit(" "), share, weight, F.lit("  ["), basis, F.lit("]"))
        lines.append(F.concat(F.lit("│  " + title.ljust(R.CARD_WIDTH, R.CARD_PADDING) + "  "), F.when(F.col(n).isNull(), F.lit("데이터 없음")).otherwise(judged)))
    lines.append(known("│    ⓘ ", F.col("trans_fat_note")))
    body = F.array(*lines)

    def part(said: Column) -> Column:
        """Lines after a bare bar, if there are any."""
        said = F.array_compact(F.coalesce(said, F.array().cast("array<string>")))
        return F.when(F.size(said) > 0, F.concat(F.array(bar), said)).otherwise(said)

    parts = [
        F.array(known("│  ⚠️ ", F.col("servings_message"))),
        F.transform("context_messages", lambda m: F.concat(F.lit("│  💬 "), m)),
    ]
    if warnings is not None:
        parts.append(F.transform(warnings, lambda w: F.concat(F.lit("│  ⚠️ Sanity: "), w["nutrient"], F.lit(" "), w["kind"], F.lit(" (값: "), _shown(w["value"]), F.lit(", 상한: "), _shown(w["bound"]), F.lit(")"))))
    card = F.array_join(F.concat(F.array_compact(body), *map(part, parts), F.array(F.lit("└" + "─" * 23))), "\n")
    return F.when(F.col("is_excluded"), F.concat(F.lit("⛔ "), name, F.lit(": "), F.coalesce(reasons[F.col("exclude_reason")], F.lit(R.EXCLUDED_OTHERWISE)))).otherwise(card)


def sanity_warnings(serving: Column, nutrients: dict[str, Column], carbs: Column | None = None, total_content: Column | None = None) -> Column:
    """Array of (nutrient, value, bound, kind) of what can't be right in one row's facts."""
    return F.array_compact(F.array(*(F.when(c, w) for c, w, _ in _checks(serving, nutrients, carbs, total_content))))


def warning_rows(df: DataFrame, keep: list[str], serving: Column, nutrients: dict[str, Column], carbs: Column | None = None, total_content: Column | None = None) -> DataFrame:
    """A row (keep, w) for each warning: the same as exploding ``sanity_warnings``, without building arrays to keep."""
    checks = _checks(serving, nutrients, carbs, total_content)
    # Rows without any warning go before arrays are built, and only what was found is exploded.
    some = df.where(reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c, _, _ in checks)))
    return some.select(*keep, F.explode(F.array_compact(F.array(*(F.when(c, w) for c, w, _ in checks)))).alias("w"))


def warning_counts(df: DataFrame, key: str, serving: Column, nutrients: dict[str, Column], carbs: Column | None = None, total_content: Column | None = None) -> DataFrame:
    """(nutrient, kind, n, n_keys) of all warnings: how many there are, and under how many values of ``key``; null is none.

    What a row fails is a bit mask, so that rows and keys are counted by mask and only few masks are exploded.
    """
    # Columns of their own, so that what several checks use is worked out, and compiled, once.
    given = {"k": F.col(key), "serving": serving, "carbs": carbs, "total": total_content, **{f"of_{n}": c for n, c in nutrients.items()}}
    given = df.select(*(c.alias(n) for n, c in given.items() if c is not None))
    checks = _checks(F.col("serving"), {n: F.col(f"of_{n}") for n in nutrients}, None if carbs is None else F.col("carbs"), None if total_content is None else F.col("total"))
    mask = reduce(lambda a, b: a + b, (F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, (c, _, _) in enumerate(checks)))
    masks = given.select("k", mask.cast("long").alias("mask"))
    rows = masks.groupBy("mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_keys"))
    keys = masks.groupBy("k").agg(F.bit_or("mask").alias("mask")).where("k IS NOT NULL").groupBy("mask").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("n_keys"))
    said = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(n).alias("nutrient"), F.lit(kind).alias("kind")) for k, (_, _, (n, kind)) in enumerate(checks)))
    each = rows.unionByName(keys).select("n", "n_keys", F.explode(F.filter(said, lambda x: F.col("mask").bitwiseAND(x["bit"]) != 0)).alias("w"))
    return each.groupBy("w.nutrient", "w.kind").agg(F.sum("n").alias("n"), F.sum("n_keys").alias("n_keys"))


def _checks(serving: Column, nutrients: dict[str, Column], carbs: Column | None, total_content: Column | None) -> list[tuple[Column, Column, tuple[str, str]]]:
    """Each check: whether it fails, the struct that says so, and the nutrient and kind in it."""
    nothing = F.lit(None).cast("double")

    def warn(cond: Column, nutrient: str, value: Column, bound: Column, kind: str) -> tuple[Column, Column, tuple[str, str]]:
        return cond, F.struct(F.lit(nutrient).alias("nutrient"), value.cast("double").alias("value"), bound.cast("double").alias("bound"), F.lit(kind).alias("kind")), (nutrient, kind)

    found = []
    for n, (most, most_100) in R.SANITY_LIMITS.items():
        if n not in nutrients:
            continue
        value = nutrients[n]
        found.append(warn(value < 0, n, value, F.lit(0.0), "negative_value"))
        found.append(warn(value > most, n, value, F.lit(most), "per_serving_exceeded"))
        if most_100 is not None:
            scaled = F.when((serving > 0) & (value >= 0), value / F.nullif(serving, F.lit(0.0)) * 100)
            found.append(warn(scaled > most_100, n, scaled, F.lit(most_100), "per_100g_exceeded"))
    get = lambda n: nutrients.get(n, nothing)
    found.append(warn(get("sat_fat") > get("total_fat"), "sat_fat", get("sat_fat"), get("total_fat"), "exceeds_total_fat"))
    if total_content is not None:
        found.append(warn((serving != 0) & (total_content != 0) & (serving > total_content), "serving_size", serving, total_content, "serving_exceeds_total"))
    if carbs is not None:
        macros = carbs + get("protein") + get("total_fat")
        found.append(warn((serving > 0) & (macros > serving * R.MASS_BALANCE), "mass_balance", macros, serving * R.MASS_BALANCE, "mass_balance_exceeded"))
        guess = carbs * 4 + get("protein") * 4 + get("total_fat") * 9
        found.append(warn((guess > 0) & (F.abs(get("calories") - guess) / F.nullif(guess, F.lit(0.0)) > R.CALORIE_DEVIATION), "calories_cross_check", get("calories"), guess, "calorie_deviation"))
    return found


def mass_balance_note(serving: Column, carbs: Column, protein: Column, fat: Column) -> Column:
    """A note where macronutrients (null: 0) exceed 110 % of the serving (unreadable: 100); never a reject."""
    zero = F.lit(0.0)
    total = F.coalesce(carbs, zero) + F.coalesce(protein, zero) + F.coalesce(fat, zero)
    share = total / F.coalesce(F.nullif(serving, zero), F.lit(100.0))
    return F.when(share > R.MASS_BALANCE, F.concat(F.lit("mass_balance:"), rounded(share, 2).cast("string")))


def sources(df: DataFrame, key: str) -> DataFrame:
    """One row (key, nutrient, color, amount_shown, unit) per nutrient that is neither green nor gray nor missing."""
    rows = F.array(*(F.struct(F.lit(n).alias("nutrient"), F.col(f"{n}_color").alias("color"), F.when(F.col(f"{n}_basis") == "pct_dv", F.col(f"{n}_pct_dv")).otherwise(F.col(f"{n}_per_100")).alias("amount_shown"), F.when(F.col(f"{n}_basis") == "pct_dv", F.lit("%")).otherwise(F.lit("per 100")).alias("unit")) for n in NEGATIVE))
    return df.select(key, F.explode(rows).alias("s")).select(key, "s.*").where("color NOT IN ('green', 'gray')")


def freshness(verified_at: Column, as_of: Column) -> dict[str, Column]:
    """Age in days, stale beyond 730 and expired beyond 1095."""
    days = F.datediff(as_of, verified_at)
    return {"age_days": days, "is_stale": F.coalesce(days > 730, F.lit(False)), "is_expired": F.coalesce(days > 1095, F.lit(False))}


def dominant_color(colors: Column) -> Column:
    """Of a group: the worst colour, at least green; gray and unknown ones count nothing."""
    return rank_color(F.greatest(F.max(color_rank(colors)), F.lit(1)))


def seed_color(c: Column, gray_allowed: bool = True) -> Column:
    """A dictionary's risk colour: lower-cased, orange as yellow, anything unknown as gray (or green)."""
    low = F.lower(F.trim(c))
    return F.when(low == "orange", F.lit("yellow")).when(low.isin("green", "yellow", "red"), low).otherwise(F.lit("gray" if gray_allowed else "green"))


def intake_text(kind: Column, value: Column, unit: Column, group: Column) -> Column:
    """Text of an acceptable daily intake by its kind."""
    return F.when(kind == "numeric", F.concat_ws(" ", value.cast("string"), unit)).when(kind == "not_specified", F.lit("not specified")).when(kind == "group", F.concat_ws(" ", F.lit("group"), group))


def description(**parts: Column) -> Column:
    """Labelled parts joined by ' | '; null parts are left out."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{k}: "), v) for k, v in parts.items()))
