"""Connected components of an edge table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.session import materialize, release

MOST_ROUNDS = 40


def _around(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour to the smallest node around, as a table."""
    both = _around(edges)
    # A table of its own, so that AQE can split the edges of a hot node in the join.
    least = materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least")), "least")
    star = materialize(both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src != dst").distinct(), "star")
    release(least)
    return star


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour, and the node itself, to the smallest one, as a table. Edges point down."""
    least = materialize(edges.groupBy("src").agg(F.min("dst").alias("least")), "least")
    moved = edges.join(least, "src").where("dst != least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    star = materialize(moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct(), "star")
    release(least)
    return star


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one other, which points nowhere."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return each.where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def connected_components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node long, component long) for each node with a link; component is its smallest node.

    Null ends and loops are left out; repeated and reversed edges don't matter, nor do other
    columns, whatever their names. No edges give no rows. Both steps keep the components; the edges become stars in a number of rounds that
    grows with the logarithm of the longest path. Each round is a table in the shared folder.
    """
    a, b = F.col(first).cast("long"), F.col(second).cast("long")
    edges = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct()
    for _ in range(MOST_ROUNDS):
        large, before = _large_star(edges), edges
        edges = _small_star(large)
        release(large, before)
        if _settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
