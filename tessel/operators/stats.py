"""Counts and statistics of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import hashed
from ..functions.numbering import numbered
from .neighbors import check_direction


def _sides(triples: DataFrame, direction: str) -> DataFrame:
    """One row per edge and side: node, other end, relation, direction."""
    check_direction(direction)
    out = triples.select(F.col("head").alias("node"), F.col("tail").alias("other"), "relation", F.lit("out").alias("direction"))
    into = triples.select(F.col("tail").alias("node"), F.col("head").alias("other"), "relation", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def relation_counts(triples: DataFrame, node: str, relation: str | None = None, direction: str = "out") -> DataFrame:
    """(direction, relation, n) of an entity; sides without rows are absent."""
    got = _sides(triples, direction).where(F.col("node") == F.lit(node))
    if relation is not None:
        got = got.where(F.col("relation") == F.lit(relation))
    return got.groupBy("direction", "relation").agg(F.count("*").alias("n"))


def batch_relation_counts(triples: DataFrame, seed_rows: DataFrame, relation: str | None = None, direction: str = "out") -> DataFrame:
    """(seed, n) for every seed, 0 for unknown ones."""
    got = _sides(triples, direction)
    if relation is not None:
        got = got.where(F.col("relation") == F.lit(relation))
    wanted = seed_rows.select("seed").distinct()
    n = got.join(wanted, F.col("node") == F.col("seed")).groupBy("seed").agg(F.count("*").alias("n"))
    return seed_rows.join(n, "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n"))


def relation_statistics(triples: DataFrame) -> DataFrame:
    """Edges, distinct heads and distinct tails of each relation."""
    return triples.groupBy("relation").agg(F.count("*").alias("n"), F.countDistinct("head").alias("heads"), F.countDistinct("tail").alias("tails"))


def entity_relations(triples: DataFrame, node: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` rows of each direction in order, with the uncapped count."""
    out = _sides(triples, "out").where(F.col("node") == F.lit(node))
    into = _sides(triples, "in").where(F.col("node") == F.lit(node))
    parts = []
    for side in (out, into):
        total = side.agg(F.count("*").alias("total"))
        top = side.orderBy("relation", "other").limit(limit)
        parts.append(top.crossJoin(F.broadcast(total)).select("direction", "relation", "other", "total"))  # one row
    return parts[0].unionByName(parts[1])


def dataset_statistics(triples: DataFrame) -> DataFrame:
    """Triples, distinct heads, tails and entities, in one row."""
    ends = triples.groupBy("head").agg(F.count("*").alias("n")).select(F.col("head").alias("node"), "n", F.lit(1).alias("h"), F.lit(0).alias("t"))
    tails = triples.groupBy("tail").agg(F.lit(0).alias("n")).select(F.col("tail").alias("node"), "n", F.lit(0).alias("h"), F.lit(1).alias("t"))
    each = ends.unionByName(tails).groupBy("node").agg(F.sum("n").alias("n"), F.max("h").alias("h"), F.max("t").alias("t"))
    zero = F.lit(0).cast("long")
    return each.agg(F.coalesce(F.sum("n"), zero).alias("triples"), F.coalesce(F.sum("h"), zero).alias("heads"), F.coalesce(F.sum("t"), zero).alias("tails"), F.count("*").alias("entities"))


def node_type_counts(triples: DataFrame) -> DataFrame:
    """Distinct entities of each type as head, as tail and at all."""
    both = triples.select(F.inline(F.array(
        F.struct(F.col("head_type").alias("node_type"), F.col("head").alias("node"), F.lit(True).alias("h"), F.lit(False).alias("t")),
        F.struct(F.col("tail_type").alias("node_type"), F.col("tail").alias("node"), F.lit(False).alias("h"), F.lit(True).alias("t")),
    )))
    each = both.groupBy("node_type", "node").agg(F.bool_or("h").alias("h"), F.bool_or("t").alias("t"))
    return each.groupBy("node_type").agg(F.count_if("h").alias("as_head"), F.count_if("t").alias("as_tail"), F.count("*").alias("total"))


def edge_type_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, distinct types and average degrees; zeros on an empty graph."""
    n = nodes.agg(
        F.count("*").alias("node_count"),
        F.countDistinct("node_type").alias("node_types"),
        F.coalesce(F.round(F.avg("degree_out"), 6), F.lit(0.0)).alias("avg_degree_out"),
        F.coalesce(F.round(F.avg("degree_in"), 6), F.lit(0.0)).alias("avg_degree_in"),
    )
    return n.crossJoin(edges.agg(F.count("*").alias("edge_count"), F.countDistinct("edge_type").alias("edge_types")))  # one row each


def adjacency_stats(adjacency: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return adjacency.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.round(F.avg("degree_out"), 6), F.lit(0.0)).alias("avg_degree_out"),
        F.coalesce(F.round(F.avg("degree_in"), 6), F.lit(0.0)).alias("avg_degree_in"),
        F.coalesce(F.max("degree_out"), zero).alias("max_degree_out"),
        F.coalesce(F.max("degree_in"), zero).alias("max_degree_in"),
        F.countDistinct("cluster_id").alias("clusters"),
    )


def degrees(triples: DataFrame) -> DataFrame:
    """(node, degree): edges that leave or enter."""
    out = triples.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("n"))
    into = triples.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("n"))
    return out.unionByName(into).groupBy("node").agg(F.sum("n").alias("degree"))


def degree_distribution(degree: DataFrame) -> DataFrame:
    return degree.agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.round(F.avg("degree"), 6).alias("mean"), F.percentile("degree", F.lit(0.5)).alias("median"))


def node_class(degree: Column) -> Column:
    return F.when(degree <= 5, "low").when(degree <= 20, "medium").otherwise("high")


def triple_class(degree: Column) -> Column:
    return F.when(degree <= 1, "isolated").when(degree <= 5, "low").when(degree <= 20, "medium").otherwise("high")


def node_classes(triples: DataFrame) -> DataFrame:
    return degrees(triples).select("node", "degree", node_class(F.col("degree")).alias("class"))


def triple_classes(triples: DataFrame) -> DataFrame:
    """Each triple with the larger degree of its ends and its class."""
    d = degrees(triples)
    # a hub's degree joins every triple it is in: where it is not broadcast, AQE splits that key's rows
    h, t = d.select(F.col("node").alias("head"), F.col("degree").alias("dh")), d.select(F.col("node").alias("tail"), F.col("degree").alias("dt"))
    top = F.greatest("dh", "dt")
    return triples.join(h, "head").join(t, "tail").select("head", "relation", "tail", top.alias("degree"), triple_class(top).alias("class"))


def tercile_seeds(nodes_with_degree: DataFrame, size: int) -> DataFrame:
    """Evenly spaced seeds of each third by (degree, node): (bucket, place, node)."""
    ranked = numbered(nodes_with_degree.select("node", "degree"), ["degree", "node"], "at")
    n = ranked.count()
    first, second = max(1, n // 3), max(2, 2 * n // 3)
    bucket = F.when(F.col("at") < first, "low").when(F.col("at") < second, "medium").otherwise("high")
    start = F.when(F.col("at") < first, 0).when(F.col("at") < second, first).otherwise(second)
    count = F.when(F.col("at") < first, min(first, n)).when(F.col("at") < second, min(second, n) - first).otherwise(n - second)
    got = ranked.select("node", bucket.alias("bucket"), (F.col("at") - start).alias("k"), count.alias("count"))
    step = F.greatest(F.lit(1), F.expr(f"count div {size}"))
    return got.withColumn("step", step).where((F.col("k") % F.col("step") == 0) & (F.expr("k div step") < size)).select("bucket", F.expr("k div step").alias("place"), "node")


def quantile_buckets(nodes_with_degree: DataFrame, low: float = 0.5, mid: float = 0.9) -> DataFrame:
    """Each node with its bucket by linear quantiles of the degree, and the two cuts."""
    if not 0 < low < mid < 1:
        raise ValueError("0 < low < mid < 1 must hold")
    cuts = nodes_with_degree.agg(F.percentile("degree", F.array(F.lit(low), F.lit(mid))).alias("q")).select(F.col("q")[0].alias("low_cutoff"), F.col("q")[1].alias("mid_cutoff"))
    got = nodes_with_degree.crossJoin(F.broadcast(cuts))  # one row
    return got.withColumn("bucket", F.when(F.col("degree") <= F.col("low_cutoff"), "low").when(F.col("degree") <= F.col("mid_cutoff"), "mid").otherwise("high"))


def sampled_seeds(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` nodes drawn by hash: the same for the same seed, whatever the partitions."""
    return nodes.select("node").distinct().orderBy(hashed(F.col("node"), F.lit(str(seed))), "node").limit(n)


def batch_groups(nodes: DataFrame, groups: int, size: int, seed: int = 42) -> DataFrame:
    """(group_id, place, node): ``groups`` draws of ``size`` nodes each."""
    parts = [numbered(sampled_seeds(nodes, size, seed + g), ["node"], "place").select(F.lit(g).alias("group_id"), "place", "node") for g in range(groups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def locality(rows: DataFrame) -> DataFrame:
    """Span, mean gap, clusters, largest cluster's share and cluster switches of a result set, in row-id order.

    Row ids are distinct first. Neighbours in order meet in bounded ranges of
    row ids: each range's ends are carried to the next one that has rows.
    """
    one = rows.groupBy("physical_row_id").agg(F.min("cluster_id").alias("cluster_id"))
    from pyspark.sql import Window

    ranged = one.withColumn("__range", F.expr("physical_row_id div 65536"))
    w = Window.partitionBy("__range").orderBy("physical_row_id")
    inner = ranged.withColumn("before", F.lag("cluster_id").over(w))
    per = inner.groupBy("__range").agg(
        F.count("*").alias("n"), F.min("physical_row_id").alias("lo"), F.max("physical_row_id").alias("hi"),
        F.sum(F.when(F.col("before") != F.col("cluster_id"), 1).otherwise(0)).alias("switches"),
        F.min_by("cluster_id", "physical_row_id").alias("first"), F.max_by("cluster_id", "physical_row_id").alias("last"),
    )
    edges = F.array_sort(F.collect_list(F.struct("__range", "first", "last")))  # one entry per 65536 row ids
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("result_count"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.sum("switches"), F.lit(0)).alias("inside"), edges.alias("e"))
    across = F.aggregate(F.sequence(F.lit(1), F.size("e") - 1), F.lit(0), lambda a, k: a + F.when(F.get("e", k)["first"] != F.get("e", k - 1)["last"], 1).otherwise(0))
    share = one.groupBy("cluster_id").agg(F.count("*").alias("c")).agg(F.count("*").alias("clusters"), F.coalesce(F.max("c"), F.lit(0)).alias("top"))
    span = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))
    return total.crossJoin(share).select(
        "result_count",
        span.alias("span"),
        F.when(F.col("result_count") > 1, F.round(span / (F.col("result_count") - 1), 6)).otherwise(0.0).alias("mean_gap"),
        "clusters",
        F.when(F.col("result_count") > 0, F.round(F.col("top") / F.col("result_count"), 6)).otherwise(0.0).alias("top_cluster_share"),
        (F.col("inside") + F.when(F.size("e") > 1, across).otherwise(0)).alias("cluster_switches"),
    )
