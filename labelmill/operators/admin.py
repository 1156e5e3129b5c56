"""Review of contributions: approve, reject, correct, report; and the counts of a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators import dedup
from labelmill.streaming.admission import stale


def _decided(contributions: DataFrame, ids: list[int], status: str) -> DataFrame:
    return contributions.withColumn("status", F.when(F.col("contribution_id").isin(*ids), F.lit(status)).otherwise(F.col("status")))


def approve(products: DataFrame, contributions: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(products, contributions): the contributions approved, their products admin_verified."""
    touched = contributions.where(F.col("contribution_id").isin(*ids)).select("product_id", F.lit("admin_verified").alias("verification")).distinct()
    return dedup.patch(products, touched, "product_id", ["verification"], overwrite=True), _decided(contributions, ids, "approved")


def reject(facts: DataFrame, contributions: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(facts, contributions): the contributions rejected; facts that came from contributions to their products go."""
    touched = contributions.where(F.col("contribution_id").isin(*ids)).select("product_id")
    own = facts.where("data_source = 'contribution'").join(touched, "product_id", "left_anti")
    return facts.where("data_source IS DISTINCT FROM 'contribution'").unionByName(own), _decided(contributions, ids, "rejected")


def correct(facts: DataFrame, contributions: DataFrame, ids: list[int], corrections: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, contributions): values of corrections (product_id, columns) put in where given; the rest stays."""
    return dedup.patch(facts, corrections, "product_id", columns, overwrite=True), _decided(contributions, ids, "corrected")


def flag_disputed(products: DataFrame, reports: DataFrame) -> DataFrame:
    """products with verification 'disputed' where reports (product_id, disputed) say so, unless admin_verified."""
    bad = reports.where("disputed").select("product_id", F.lit(True).alias("is_bad")).distinct()
    verification = F.when(F.coalesce("is_bad", F.lit(False)) & (F.coalesce("verification", F.lit("")) != "admin_verified"), F.lit("disputed")).otherwise(F.col("verification"))
    return products.join(bad, "product_id", "left").select(*(verification.alias(c) if c == "verification" else F.col(c) for c in products.columns))


def dashboard(products: DataFrame, as_of: Column) -> DataFrame:
    """One row: products, verified and disputed ones, stale ones, and the verified share in percent."""
    verified = F.col("verification").isin("verified", "admin_verified")
    total = F.count("*")
    return products.agg(total.alias("total"), F.count_if(verified).alias("verified"), F.count_if(F.col("verification") == "disputed").alias("disputed"), F.count_if(stale(F.col("verified_at"), as_of)).alias("stale"), F.round(F.count_if(verified) * 100.0 / F.nullif(total, F.lit(0)), 1).alias("verified_rate"))
