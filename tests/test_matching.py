"""Exclusive matching against the sequential loop: few equal rows, very many, nested lists, chains."""

import random

import pytest
from pyspark.sql import functions as F

from labelmill.operators import enrich, link, matching
from tests.test_operators import greedy


def matched(spark, edges, settled):
    df = spark.createDataFrame(edges, "l int, r long, s double")
    got = link.exclusive_match(df, "l", "r", "s", settled)
    assert got.dtypes == [("l", "int"), ("r", "bigint"), ("s", "double")]
    best = {}
    for a, b, s in edges:
        best[a, b] = max(s, best.get((a, b), s))
    rows = got.collect()
    assert all(x.s == best[x.l, x.r] for x in rows)
    return sorted((x.l, x.r) for x in rows)


def whole(edges):
    best = {}
    for a, b, s in edges:
        best[a, b] = max(s, best.get((a, b), s))
    return greedy([(a, b, s) for (a, b), s in best.items()])


@pytest.mark.parametrize("settled", [0, 40, 10**6])
def test_random_graphs(spark, settled):
    rng = random.Random(settled)
    for n, share in ((12, 0.5), (30, 0.12)):
        edges = [(a, b, rng.randint(1, 4) / 4) for a in range(n) for b in range(n) if rng.random() < share]
        # Rows with the list of another one, at other places in the order, and an edge said twice.
        for a, twin in ((n + 3, 2), (n + 1, 5), (-4, 2)):
            edges += [(a, b, s) for x, b, s in edges if x == twin]
        edges.append((*edges[0][:2], 0.01))
        assert matched(spark, edges, settled) == whole(edges)


def test_chain_of_dependent_rows(spark):
    edges = [(a, b, 1.0 - b / 100) for a in range(14) for b in range(14) if (a + b) % 5 or b == 0]
    assert matched(spark, edges, 0) == matched(spark, edges, 10**6) == whole(edges)


def test_rows_of_one_name_take_no_round_each(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(matching, "_hand_out", lambda *a, f=matching._hand_out: rounds.append(1) or f(*a))
    members = spark.range(50_000).select((F.col("id") % 3).alias("block"), (F.col("id") * 7 % 50_000).alias("left"))
    # Three lists, of which two share a third of their rows.
    lists = spark.range(60_000).select(F.explode(F.when(F.col("id") % 3 == 0, F.array(F.lit(0), F.lit(1))).when(F.col("id") % 3 == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(2)))).alias("block"), F.col("id").alias("right"), F.lit(1.0).alias("score"))
    got = {r.left: r.right for r in matching.match_blocks(members, lists, 10_000).collect()}
    block = {r.left: r.block for r in members.collect()}
    free = {0: [x for x in range(60_000) if x % 3 < 2], 1: [x for x in range(60_000) if x % 3 == 0], 2: [x for x in range(60_000) if x % 3 == 2]}
    at, used, want = dict.fromkeys(free, 0), set(), {}
    for left in sorted(block):
        own, b = free[block[left]], block[left]
        while at[b] < len(own) and own[at[b]] in used:
            at[b] += 1
        if at[b] < len(own):
            want[left] = own[at[b]]
            used.add(own[at[b]])
    assert got == want and len(want) > 40_000
    assert len(rounds) <= 8


def plain_substrings(products, facts):
    used, out = set(), []
    for fact, food in sorted((f, t.strip(" ").lower()) for f, t in facts if f is not None and t is not None):
        free = sorted(p for p, name in products if food and name is not None and food in name.lower() and p not in used)
        if free:
            used.add(free[0])
            out.append((fact, free[0]))
    return out


def test_facts_of_equal_and_nested_names(spark):
    products = [(k, f"{c} {n} {s}") for k, (c, n, s) in enumerate((c, n, s) for s in ("small", "LARGE") for c in ("red", "Green") for n in ("apple", "apple chips", "tea"))] + [(99, None), (98, "")]
    facts = [(100 + k, n) for k, n in enumerate(["apple"] * 5 + ["Apple chips"] * 4 + ["chips", "tea", " tea ", "tea small", "a", "e", None, "", "  ", "no such"] + ["red"] * 3)] + [(None, "apple")]
    got = enrich.substring_facts(spark.createDataFrame(products, "product_id int, product_name string"), spark.createDataFrame(facts, "fact_id int, food_name string"))
    assert sorted((r.fact_id, r.product_id) for r in got.collect()) == plain_substrings(products, facts)


def test_null_ids_and_empty_tables(spark):
    edges = spark.createDataFrame([(1, 1, None), (None, 1, 1.0), (2, None, 1.0)], "l int, r long, s double")
    assert link.exclusive_match(edges, "l", "r", "s").collect() == [] == link.exclusive_match(edges.limit(0), "l", "r", "s", 0).collect()


@pytest.mark.parametrize("settled", [0, 10**6])
def test_classes_of_right_rows(spark, settled):
    rng = random.Random(5)
    members = [(rng.randrange(8) * 10, left) for left in range(60)]
    rights = [(rng.randrange(100, 112), right) for right in range(500, 550)]
    lists = [(b * 10, g, rng.randint(1, 3) / 4) for b in range(8) for g in range(100, 112) if rng.random() < 0.3]
    dfs = [spark.createDataFrame(rows, schema) for rows, schema in ((members, "block long, left long"), (rights, "`group` long, right long"), (lists, "block long, `group` long, score double"))]
    got = matching.match_classes(*dfs, settled).collect()
    edges = [(left, right, s) for b, g, s in lists for x, left in members if x == b for y, right in rights if y == g]
    assert sorted((r.left, r.right) for r in got) == greedy(edges) and len(got) > 20
    scores = {(a, b): s for a, b, s in edges}
    assert all(scores[r.left, r.right] == r.score for r in got)


def test_facts_of_one_name_make_no_row_for_each_product(spark, monkeypatch):
    monkeypatch.setattr(matching, "match_blocks", None)
    products = [(k, f"apple {k % 3}") for k in range(60)] + [(0, "Apple tea"), (60, "tea")]
    facts = [(100 + k, ("apple", "tea", "apple 1", "le 2")[k % 4]) for k in range(90)]
    got = enrich.substring_facts(spark.createDataFrame(products, "product_id int, product_name string"), spark.createDataFrame(facts, "fact_id int, food_name string"))
    assert sorted((r.fact_id, r.product_id) for r in got.collect()) == plain_substrings(products, facts)
