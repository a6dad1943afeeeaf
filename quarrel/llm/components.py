"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u > v). Large star: every node hands its larger neighbours its smallest one; small star: its smaller neighbours.

    The smallest neighbour is a plain aggregate, so a node with any number of neighbours is combined before the shuffle. It
    is stored before it is joined, so that adaptive execution can split the neighbours of such a node.
    """
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        edges = stored(edges, "edges")
        least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the smallest id reachable from it. Self loops and repeats don't matter; no edges give no rows."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        now = stored(_star(_star(now, True), False).distinct(), "edges")
        out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        # Done when all are stars: each id has one row. A larger end may still have two smaller ones when none of them is a larger end.
        if out.groupBy("id").count().where("count > 1").isEmpty():
            return out
