"""Coverage, anomaly and profile reports in one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators.dedup import first_per_group


def coverage_measures(checks: dict[str, Column]) -> dict[str, Column]:
    """total, and count and rate (in percent, one digit) of rows that pass each check, for one aggregation or ``landing.write_observed``."""
    total = F.count("*")
    rate = lambda n: F.round(n * 100.0 / F.nullif(total, F.lit(0)), 1)
    return {"total": total} | {k: v for name, check in checks.items() for k, v in ((name, F.count_if(check)), (f"{name}_rate", rate(F.count_if(check))))}


def status_measures(status: str, known: tuple[str, ...]) -> dict[str, Column]:
    """Count and rate of each known status of a decision log, and of those that are none of them."""
    return coverage_measures({s: F.col(status) == s for s in known} | {"other": F.coalesce(~F.col(status).isin(*known), F.lit(True))})


def null_measures(columns: list[str]) -> dict[str, Column]:
    """Share of nulls of each column, in percent."""
    return {c: F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1) for c in columns}


def coverage(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: total, and count and rate (in percent, one digit) of rows that pass each check."""
    return df.agg(*(c.alias(name) for name, c in coverage_measures(checks).items()))


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key; null is a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, null_rate) in percent of each column, in one pass."""
    one = df.agg(*(m.alias(c) for c, m in null_measures(columns).items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in columns))).alias("r")).select("r.*")


def coverage_by(df: DataFrame, key: str, present: str, least: int = 10, most: int | None = 15) -> DataFrame:
    """(key, total, with_value, rate) of keys with at least ``least`` rows, best covered first."""
    out = df.groupBy(key).agg(F.count("*").alias("total"), F.count(present).alias("with_value")).where(F.col("total") >= least)
    out = out.withColumn("rate", F.round(F.col("with_value") * 100.0 / F.col("total"), 1))
    return out if most is None else out.orderBy(F.col("rate").desc(), F.col("total").desc(), key).limit(most)


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bucket, n): the highest edge that a value reaches; below all is the bucket -1."""
    bucket = F.when(F.lit(False), F.lit(0.0))
    for e in sorted(edges, reverse=True):
        bucket = bucket.when(F.col(value) >= e, F.lit(float(e)))
    return df.where(F.col(value).isNotNull()).groupBy(bucket.otherwise(F.lit(-1.0)).alias("bucket")).agg(F.count("*").alias("n"))


def variants(df: DataFrame, raw: str, normal: Column, most: int = 50) -> DataFrame:
    """(normal_form, names, n_names): raw spellings that share a normal form, most first."""
    out = df.select(normal.alias("normal_form"), F.col(raw).alias("raw_name")).where("normal_form != ''").groupBy("normal_form").agg(F.array_join(F.array_sort(F.collect_set("raw_name")), "|").alias("names"), F.countDistinct("raw_name").alias("n_names"))
    return out.where("n_names > 1").orderBy(F.col("n_names").desc(), "normal_form").limit(most)


def keyword_lookup(keywords: DataFrame, items: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """For each keyword of (keyword) the first item by ``order`` whose name holds it, whatever the case; none gives nulls.

    Keywords are found by ``link.dictionary_hits`` in the distinct names, so any number will do.
    """
    from labelmill.operators import link

    low = F.lower(F.col(name))
    names = items.select(low.alias("low_name"), low.alias("low_text")).where("low_name IS NOT NULL").distinct()
    hits = link.dictionary_hits(names, keywords.select(F.lower("keyword").alias("low_word")), "low_name", "low_text", "low_word")
    found = items.withColumn("low_name", low).join(hits, "low_name")
    best = first_per_group(found, ["low_word"], order, 1, "rank").drop("rank", "low_name")
    return keywords.withColumn("low_word", F.lower("keyword")).join(best, "low_word", "left").drop("low_word")


def keyword_sources(keywords: DataFrame, first: DataFrame, second: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """(keyword, first_name, second_name, found_in): the best item of each source that holds a keyword, and
    whether 'both', only the 'first', only the 'second' or 'neither' has one."""
    sides = [keyword_lookup(keywords.distinct(), df, name, order).select("keyword", F.col(name).alias(new)) for df, new in ((first, "first_name"), (second, "second_name"))]
    a, b = F.col("first_name").isNotNull(), F.col("second_name").isNotNull()
    found = F.when(a & b, "both").when(a, "first").when(b, "second").otherwise("neither")
    return sides[0].join(sides[1], "keyword").withColumn("found_in", found)


def keyword_coverage(keywords: DataFrame, items: DataFrame, name: str, active: Column, filled: Column, key: str) -> DataFrame:
    """keyword_lookup over active items, and over all where none is active: those with facts first, then short names."""
    return keyword_lookup(keywords, items, name, [active.cast("int").desc(), filled.cast("int").desc(), F.length(name), F.col(key)])


def anomaly_tops(df: DataFrame, key: str, kinds: dict[str, tuple[Column, Column]], most: int = 10) -> DataFrame:
    """(kind, key, value) of the ``most`` highest values of each kind, a pair of (condition, value), among rows that meet it."""
    rows = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"))) for kind, (cond, value) in kinds.items())))
    found = df.select(key, F.explode(rows).alias("r")).select("r.kind", key, "r.value")
    return first_per_group(found, ["kind"], [F.col("value").desc(), F.col(key)], most, "rank").drop("rank")


def product_checks(df: DataFrame, compared: int | None = 50) -> DataFrame:
    """df with a mark for each of five checks, the issues found, and is_clean (no issue).

    df has raw_text, registered_text, additives (array of names), has_facts, sodium, calories,
    serving, fat, carbs, protein, is_excluded, judged (colours that could be given), category
    (stored) and detected. Marks: O fine, △ doubtful, X missing or wrong, - not applicable, ?
    unknown. Ingredient texts are compared on their first ``compared`` characters (None: all).
    """
    from labelmill.functions import normalize

    head = lambda c: F.trim(F.coalesce(F.col(c) if compared is None else F.substring(c, 1, compared), F.lit("")))
    text = normalize.folded_key(F.col("raw_text"))
    unread = F.filter(F.coalesce("additives", F.array().cast("array<string>")), lambda a: (text != "") & (normalize.folded_key(a) != "") & ~F.contains(text, normalize.folded_key(a)))
    df = df.withColumn("unread", unread)
    has_text, zero = F.col("raw_text").isNotNull(), F.lit(0.0)
    mass = F.coalesce("fat", zero) + F.coalesce("carbs", zero) + F.coalesce("protein", zero)
    odd = {"sodium": F.col("sodium") > 10000, "calories_low": F.col("calories") <= 0, "calories_high": F.col("calories") > 2000, "mass": (F.col("serving") > 0) & (mass > F.col("serving") * 1.1) & (mass > 10)}
    facts = F.coalesce("has_facts", F.lit(False))
    anomalies = F.when(facts, F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in odd.items())))).otherwise(F.array().cast("array<string>"))
    stored = F.coalesce("category", F.lit("general"))
    fits, vague = F.col("detected") == stored, stored == "general"
    mark = lambda c: F.when(c, F.lit("O"))
    checks = {
        "ingredients": mark(has_text).otherwise("X"),
        "additives_check": F.when(F.size("unread") > 0, "△").when(F.size("additives") > 0, "O").otherwise("-"),
        "nutrition": F.when(~facts, "X").when(F.size(anomalies) > 0, "△").otherwise("O"),
        "traffic_light": F.when(~facts | F.coalesce("is_excluded", F.lit(False)), "-").when(F.col("judged") > 0, "O").otherwise("?"),
        "category_check": mark(fits).when(vague, "△").otherwise("X"),
    }
    issues = [
        F.when(~has_text, F.lit("no_ingredients")).when((head("raw_text") != "") & (head("registered_text") != "") & (head("raw_text") != head("registered_text")), F.lit("registered_text_differs")),
        F.when(F.size("unread") > 0, F.concat(F.lit("additives_not_in_text:"), F.size("unread").cast("string"))),
        F.when(~facts, F.lit("no_nutrition")).when(F.size(anomalies) > 0, F.concat(F.lit("anomaly:"), F.array_join(anomalies, ";"))),
        F.when(~fits, F.concat(F.lit("category:"), stored, F.lit(">"), F.col("detected"))),
    ]
    out = df.withColumns(checks | {"issues": F.array_compact(F.array(*issues))})
    return out.withColumn("is_clean", F.size("issues") == 0).drop("unread")


def longest_prefix(df: DataFrame, text: str, words: list[str]) -> Column:
    """Length of the longest prefix of the text that is in the list of words; 0 if none."""
    known = F.array(*(F.lit(w) for w in words))
    return F.coalesce(F.array_max(F.transform(F.filter(known, lambda w: F.col(text).startswith(w)), lambda w: F.length(w))), F.lit(0))


def grade(clean_ratio: Column) -> Column:
    """A from 90 % clean, B from 75, C from 60, else D."""
    return F.when(clean_ratio >= 0.9, F.lit("A")).when(clean_ratio >= 0.75, F.lit("B")).when(clean_ratio >= 0.6, F.lit("C")).otherwise(F.lit("D"))
