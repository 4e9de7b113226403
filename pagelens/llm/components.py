"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation (combined before the shuffle, so a hub costs one row
a task) and one join back to the edges; a large star makes no more edges than it gets,
so they lose their repeats in the small star only.  Edges shrink to stars around the
smallest id; rounds grow with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import cut


def _from_both(edges: DataFrame) -> DataFrame:
    """Each edge as seen from its u (up 1) and from its v (up 0), in one scan: a union would have twice the tasks."""
    seen = [F.struct(F.col(a).alias("u"), F.col(b).alias("v"), F.lit(up).alias("up")) for a, b, up in (("u", "v", 1), ("v", "u", 0))]
    return edges.select(F.inline(F.array(*seen)))


def _large_star(edges: DataFrame) -> DataFrame:
    least = _from_both(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # of u's edges the one to m stays, the others' ends go to m
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Are the edges (u > v) stars: one v for each u, and no v that is a u too?"""
    ends = _from_both(edges).groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return ends.where("up > 1 or up = 1 and least = 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) -> (id, component): each id of an edge with the smallest id it reaches.

    No edges give no rows; loops and repeated edges change nothing; edges with a
    null end are left out.
    """
    edges = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    for _ in range(most_rounds):
        edges = cut(_small_star(cut(_large_star(edges))))  # written between, since a small star reads its edges twice
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
