"""Sums of prices don't depend on the order of the lines."""

import random

import pytest
from pyspark.sql import functions as F

from labelmill.operators import score
from labelmill.plans import QUERIES
from labelmill.plans.scoring import exact_sum


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """One part whose prices are 1000.00 together, in an order in which adding them up as doubles gives less."""
    rng, cents = random.Random(3), []
    while True:
        cents = [rng.randint(1, 12_000) for _ in range(15)]
        cents.append(100_000 - sum(cents))
        prices = [c / 100 for c in cents]
        if cents[-1] > 0 and sum_of(prices) < 1000:
            break
    d = str(tmp_path_factory.mktemp("sums"))
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame([(k, 1, 1, 1, 5.0, p, 0.05, 0.02) for k, p in enumerate(prices)], line).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, "hot nut", "Brand#7", "LARGE", 33, 900.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{d}/part.parquet")
    return d


def sum_of(prices):
    total = 0.0
    for p in prices:
        total += p
    return total


def test_card_shows_the_whole_calorie(spark, data):
    assert "열량      1kcal" in QUERIES["text_card"](spark, data).first().card


def test_exact_sum_of_odd_values(spark):
    rows = [("a", 0.1)] * 10 + [("b", 1e300), ("b", 1.0), ("c", float("nan")), ("c", 1.0), ("d", float("inf")), ("d", None), ("e", None), ("f", -0.3), ("f", None)]
    got = spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(exact_sum(F.col("v")).alias("s"))
    assert {r.k: str(r.s) for r in got.collect()} == {"a": "1.0", "b": "1e+300", "c": "nan", "d": "inf", "e": "None", "f": "-0.3"}


def test_share_of_calories_at_a_rounding_edge(spark, data):
    assert QUERIES["traffic_light_positive"](spark, data).first().calories_pct_dv == 0.1


def test_warnings_are_counted_without_being_exploded(spark):
    rows = [(1, 10.0, -5.0, 20.0, 3.0), (1, 10.0, 3000.0, 1.0, 3.0), (2, 0.0, 950.0, 40.0, 50.0), (None, 5.0, -1.0, 1.0, 2.0), (3, None, None, None, None), (4, 100.0, 40.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, s double, calories double, sat_fat double, total_fat double")
    nutrients = {n: F.col(n) for n in ("calories", "sat_fat", "total_fat")}
    got = score.warning_counts(df, "k", F.col("s"), nutrients, carbs=F.col("s") * 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    want = score.warning_rows(df, ["k"], F.col("s"), nutrients, carbs=F.col("s") * 2).groupBy("w.nutrient", "w.kind").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_keys"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 4
    # Each is exploded after rows and keys are counted by what they fail.
    assert plan.count("Generate") == plan[: plan.index("Aggregate", plan.index("Union"))].count("Generate")
