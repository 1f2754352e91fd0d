"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.frames import written
from residua.operators._keys import join_on_keys


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a bigint, b bigint)``; root is the component's least node.

    Large-star and small-star steps replace each node's edges by edges to its
    least neighbour; the number of edges never grows, and rounds grow with
    the logarithm of the longest path.  Rounds are written to the shared
    folder.  Only two numbers a round reach the driver.  A hub's edges meet
    its least neighbour in a join on a key of its own, so that side arrives
    by an exchange and Spark can split the hub's partition.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "components")
    seen = _state(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # larger neighbours point to the least neighbour
        large = (join_on_keys(both.filter("b > a"), least, ["a"], "inner")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        large = written(large, "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # a node and its smaller neighbours point to the least of them
        small = join_on_keys(large, least, ["a"], "inner")
        small = written(small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "components")
        state = _state(small)
        if state == seen:
            break
        now, seen = small, state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
