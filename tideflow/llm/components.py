"""Connected components of an edge table, by alternating large-star and small-star joins.

Each round is a grouped minimum and a join, so that a node with very many edges is a hot key only of a join, which
adaptive execution splits; nothing is gathered into one task and nothing goes to the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm.common import discard, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: u > v. Large star: larger neighbours of a node go to the least of it and its neighbours. Small star: a node and its smaller neighbours go to the least of them."""
    if small:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        # the least neighbour of v is below v where v has a smaller one; else v itself is the least of its star
        moved = edges.join(low, edges.v == low.n, "left").select("u", F.coalesce("m", "v").alias("v"))
        moved = moved.unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of long ids, in any direction, with repeats. Returns node, component: the least node that it reaches, for every node with an edge to another; nodes without one are not listed."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        before, now = now, materialise(_star(_star(now, small=False), small=True))
        discard(before)
        then, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == then:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")
