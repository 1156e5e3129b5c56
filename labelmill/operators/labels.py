"""Whole labels: from recognised text to facts, scores and gate decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions import extract, normalize, parse
from labelmill.operators import score
from labelmill.streaming import admission


def flatten_blocks(pages: DataFrame, key: str, blocks: str) -> DataFrame:
    """(key, text, confidence) of recognised pages: ``blocks`` is an array of (text, confidence); the texts are
    joined by line ends, the confidence is their mean, 0 without any."""
    b = F.col(blocks)
    n = F.size(b)
    mean = F.when(n > 0, F.aggregate(b, F.lit(0.0), lambda s, x: s + F.coalesce(x["confidence"].cast("double"), F.lit(0.0))) / n).otherwise(F.lit(0.0))
    return pages.select(key, F.array_join(F.transform(b, lambda x: x["text"]), "\n").alias("text"), mean.alias("confidence"))


def analyze_labels(labels: DataFrame, dictionary: list[tuple[str, str]], corrections: list[tuple[str, str]] = (), most_characters: int | None = None) -> DataFrame:
    """labels (text, confidence, product_name, food_type, content_unit, total_content and others) with what the text says.

    Adds label_text (corrected; whole unless ``most_characters`` is given), section, items, found_additives, allergens, the ten
    nutrients, the scorer's columns, warnings and reject_reason. Null texts give empty results.
    """
    text, _ = normalize.corrected(extract.capped(F.coalesce("text", F.lit("")), most_characters), list(corrections))
    read = labels.withColumn("label_text", text).withColumn("section", extract.ingredient_section(F.col("label_text")))
    size, unit = extract.serving(F.col("label_text"))
    facts = extract.nutrients(F.col("label_text"))
    names = {"total_sugars": "sugars", "saturated_fat": "sat_fat", "dietary_fiber": "fiber"}
    read = read.withColumns({names.get(n, n): c for n, c in facts.items()} | {"serving_size": size, "serving_unit": unit, "allergens": extract.allergens(F.col("label_text"))})
    read = read.withColumn("parsed", parse.read_labels(dictionary)(F.col("section")))
    read = read.withColumns({"items": F.col("parsed.items"), "found_additives": F.col("parsed.additives")}).drop("parsed")
    scored = score.evaluate(read)
    nutrients = {n: F.col(n) for n in ("calories", "sodium", "sugars", "total_fat", "sat_fat", "protein", "cholesterol", "trans_fat", "fiber")}
    scored = scored.withColumn("warnings", score.sanity_warnings(F.col("serving_size"), nutrients, carbs=F.col("total_carbs"), total_content=F.col("total_content")))
    return scored.withColumn("reject_reason", admission.gate(F.col("confidence"), F.col("warnings"), F.lit(False), F.lit(False)))
