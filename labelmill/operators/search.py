"""Lookups, searches and lists over a product table, and the product card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import similarity as S
from labelmill.operators import score

SIMILAR = 0.3


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """The row of a natural key."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def valid_barcode(c: Column) -> Column:
    return F.coalesce(c.rlike("^\\d{8,14}$"), F.lit(False))


def check_page(q: str, limit: int, offset: int) -> None:
    if not q.strip() or not 1 <= limit <= 50 or offset < 0:
        raise ValueError("q must not be blank, limit from 1 to 50, offset from 0")


def search(df: DataFrame, name: str, q: str, limit: int = 20, offset: int = 0, key: str | None = None) -> DataFrame:
    """Rows whose name holds q (any case; % and _ are live) or is similar to it, most similar first."""
    check_page(q, limit, offset)
    sim = S.word_similarity(F.col(name), F.lit(q))
    order = [F.col("sim").desc(), F.col(name), *([F.col(key)] if key else [])]
    return df.withColumn("sim", sim).where(F.ilike(F.col(name), F.lit(f"%{q}%")) | (F.col("sim") >= SIMILAR)).orderBy(*order).offset(offset).limit(limit)


def recent(df: DataFrame, at: str, key: str, limit: int = 20) -> DataFrame:
    """Newest rows, unknown times first."""
    return df.orderBy(F.col(at).desc_nulls_first(), F.col(key)).limit(limit)


def additive_summary(links: DataFrame, additives: DataFrame, product: str, additive: str, color: str) -> DataFrame:
    """Per product: total, count by colour (gray in total only), dominant colour."""
    rows = links.select(product, additive).distinct().join(additives.select(additive, color), additive)
    counts = [F.count_if(F.col(color) == c).alias(f"n_{c}") for c in ("green", "yellow", "orange", "red")]
    return rows.groupBy(product).agg(F.count("*").alias("total"), *counts, score.dominant_color(F.col(color)).alias("dominant"))


def product_card(products: DataFrame, key: str, *details: DataFrame, category: Column | None = None) -> DataFrame:
    """Products with what is known of them (facts, additives; optional for each product), scored."""
    for known in details:
        products = products.join(known, key, "left")
    return score.evaluate(products, category)


def pending(contributions: DataFrame, kind: str = "all") -> DataFrame:
    """Open contributions: all, disputed ones, or ones whose payload names allergens."""
    rows = contributions.where(F.col("status").isin("pending", "disputed"))
    if kind == "disputed":
        rows = rows.where("status = 'disputed'")
    elif kind == "allergen":
        rows = rows.where(F.size(F.from_json(F.get_json_object("data", "$.allergens"), "array<string>")) > 0)
    elif kind != "all":
        raise ValueError("kind must be all, disputed or allergen")
    return rows.orderBy(F.when(F.col("status") == "disputed", 0).otherwise(1), F.col("created_at").desc_nulls_first())
