"""Connected components by contraction, with no group of edges in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges(a, b).

    Each round sends a node to its smallest neighbour, shortens the ways once
    and contracts the edges; neighbours meet only in a minimum, which is
    aggregated before it is shuffled.  A round writes its parents and the edges
    that are left, nothing else: each job leaves its plan and broadcasts with
    the driver.  The rounds' parents are joined at the end.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    parents, left = [], written(both.where("u <> v").distinct(), "edges")
    while not left.isEmpty():
        every = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = every.groupBy("u").agg(F.least("u", F.min("v")).alias("p"))
        up = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        near = near.join(up, "p").select("u", F.col("q").alias("p"))
        near = written(near.join(up, "p").select("u", F.col("q").alias("p")), "parents")
        parents.append(near)
        pv = near.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = left.join(near, "u").join(pv, "v").where("p <> pv").select(F.col("p").alias("u"), F.col("pv").alias("v"))
        left = written(moved.distinct(), "edges")
    if not parents:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mapping = parents[0]
    for near in parents[1:]:
        onward = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        mapping = mapping.join(onward, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    return mapping.select(F.col("u").alias("node"), F.col("p").alias("component"))
