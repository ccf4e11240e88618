"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Every node points to its least neighbour, pointers are followed to their
    ends, and the edges are drawn anew between those ends: what is connected
    becomes one node, so edges fall away round by round and all rounds together
    handle little more than the first. Each round is checkpointed; only whether
    anything is left reaches the driver.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    whole = links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first = True
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")).checkpoint()
        while True:
            up = ends.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
            moved = ends.join(up, F.col("root") == F.col("up")).select("node", F.col("up_root").alias("root"), (F.col("root") != F.col("up_root")).alias("moved")).checkpoint()
            ends = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        now = ends.select(F.col("node").alias("was"), F.col("root").alias("now"))
        whole = ends if first else whole.join(now, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")).checkpoint()
        first = False
        links = links.join(now, F.col("a") == F.col("was")).select(F.col("now").alias("a"), "b").join(now, F.col("b") == F.col("was")).select("a", F.col("now").alias("b"))
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    return whole
