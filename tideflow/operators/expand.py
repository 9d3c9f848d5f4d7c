"""One row to many, and walks over graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.flow import OrderedFlow
from tideflow.plans.scratch import written


def flat_map(flow: OrderedFlow, items: Column, name: str = "item") -> OrderedFlow:
    """A row for each element of an array, in order; `pos` joins the order key."""
    return OrderedFlow(flow.df.select("*", F.posexplode(items).alias("pos", name)), (*flow.order_by, "pos"), flow.partition_by)


concat_map = flat_map


def expand_map(roots: DataFrame, edges: DataFrame, node: str = "node", parent: str = "parent", child: str = "child", max_depth: int | None = None, max_items: int | None = None, visited_by: bool = False, visited: DataFrame | None = None) -> DataFrame:
    """Breadth first from the roots along the edges: node and depth, a row for every path to a node, so that cycles need max_depth, max_items or visited_by. visited_by: a node is met once, at its least depth, so cycles end; with `visited` those nodes, and what hangs below them, are skipped from the start. Each level is one join; what was met is kept as a written table, not on the driver."""
    once = visited_by or visited is not None
    seen = visited.select(F.col(visited.columns[0]).alias(node)).distinct() if visited is not None else None
    level = roots.select(node)
    if once:
        level = level.distinct()
    if seen is not None:
        level = level.join(seen, node, "left_anti")
    level = written(level.withColumn("depth", F.lit(0)))
    met, depth = level, 0
    count = level.count() if max_items else 0
    while (max_depth is None or depth < max_depth) and not (max_items and count >= max_items):
        depth += 1
        following = level.join(edges, F.col(node) == F.col(parent)).select(F.col(child).alias(node))
        if once:
            following = following.distinct().join(met, node, "left_anti")
        if seen is not None:
            following = following.join(seen, node, "left_anti")
        level = written(following.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        met = met.unionByName(level)
        count += level.count() if max_items else 0
    return met.orderBy("depth", node).limit(max_items) if max_items and max_items > 0 else met
