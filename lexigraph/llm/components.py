"""Connected components of an edge table, by rounds of joins and minimums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.common import checkpointed, salted_join


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b), root being the component's smallest node.

    Each round hands all smaller neighbours of a node to the smallest of them, until every node has one at most. That
    forest has the components of the graph, and its pointers are then doubled until they reach the roots. Loops on
    one node and repeated edges are ignored; an empty table gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = checkpointed(pairs)
    while True:
        low = salted_join(pairs, pairs.groupBy("a").agg(F.min("b").alias("low")), "a", F.col("b"))
        if low.where("b <> low").limit(1).count() == 0:
            break
        moved = low.select(F.inline(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))))
        pairs = checkpointed(moved.where("a <> b").distinct())
    up = pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
    while True:
        further = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        up = checkpointed(salted_join(up, further, "root", F.col("id")).select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if up.where("moved").limit(1).count() == 0:
            break
    roots = up.select("root").distinct().select(F.col("root").alias("id"), "root")
    return up.select("id", "root").union(roots)
