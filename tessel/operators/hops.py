"""Multi-hop queries, for many seeds in one plan.

``khop`` visits each node once per seed, so cycles end; ``trails`` follow
edges, each at most once, so a seed can come back through a cycle. The loops
run on the driver over plan handles alone; deep walks are cut by checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import ensure_checkpoints, numbered
from .neighbors import check_direction

#: A frontier of up to this many rows is looked up by key; one of up to BROADCAST rows is sent to the scans; a larger one is shuffled.
LOOKUP, BROADCAST = 1000, 100_000

#: Restricted triples: those with one of the heads, or with one of the tails.
Lookup = Callable[[list[str] | None, list[str] | None], DataFrame]


def steps(triples: DataFrame, direction: str = "out") -> DataFrame:
    """(src, dst) as walked in the direction."""
    check_direction(direction)
    out = triples.select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    into = triples.select(F.col("tail").alias("src"), F.col("head").alias("dst"))
    return out if direction == "out" else into if direction == "in" else out.union(into)


def _steps_from(lookup: Lookup, ids: list[str], direction: str) -> DataFrame:
    parts = []
    if direction != "in":
        parts.append(steps(lookup(ids, None), "out"))
    if direction != "out":
        parts.append(steps(lookup(None, ids), "in"))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _check_k(k: int) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError("k must be a whole number of at least 1")


def khop(triples: DataFrame, seed_rows: DataFrame, k: int, direction: str = "out", lookup: Lookup | None = None, counted: dict[str, int] | None = None) -> DataFrame:
    """(seed, node, depth): each node within k hops once, at its least depth, without the seed.

    While a frontier is small its ids go into the scan's filter by ``lookup``;
    a larger one is broadcast up to a checked size, and then joined by shuffle.
    Edges are never shuffled for a small frontier. ``counted`` gets how many
    frontiers were looked up and how many edge joins were planned.
    """
    _check_k(k)
    check_direction(direction)
    spark = triples.sparkSession
    pairs = "seed string, node string"
    frontier = seed_rows.select("seed", F.col("seed").alias("node")).distinct()
    seen, found = frontier, spark.createDataFrame([], pairs + ", depth int")
    for h in range(1, k + 1):
        top = frontier.limit(LOOKUP + 1).collect()
        if not top:
            return found
        small = len(top) <= LOOKUP
        if small:  # known rows instead of the plan that made them
            frontier = spark.createDataFrame([tuple(r) for r in top], pairs)
            side = F.broadcast(frontier)
        else:
            ensure_checkpoints(spark)
            frontier = frontier.checkpoint()
            side = F.broadcast(frontier) if frontier.count() <= BROADCAST else frontier
        if h > 1:
            found = found.unionByName(frontier.withColumn("depth", F.lit(h - 1)))
            seen = seen.unionByName(frontier)
        if counted is not None:
            counted["take_row_ids_count"] += 1
            counted["query_count"] += 1
        edge = _steps_from(lookup, sorted({r["node"] for r in top}), direction) if small and lookup else steps(triples, direction)
        near = edge.join(side, F.col("src") == F.col("node")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = near.join(seen, ["seed", "node"], "left_anti")
    return found.unionByName(frontier.withColumn("depth", F.lit(k)))


def exact_hops(triples: DataFrame, seed_rows: DataFrame, k: int, direction: str = "out", lookup: Lookup | None = None) -> DataFrame:
    """Nodes at distance k, not nearer."""
    return khop(triples, seed_rows, k, direction, lookup).where(F.col("depth") == k)


def layered(edges: DataFrame, seed: str, k: int) -> DataFrame:
    """Per hop, the first edge in edge order that reaches each new node."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(seed,)], "node string")
    seen, layers = frontier, None
    for h in range(1, k + 1):
        reach = edges.join(frontier, F.col("src_id") == F.col("node"), "left_semi")
        first = reach.groupBy(F.col("dst_id").alias("node")).agg(F.min_by(F.struct("edge_id", "src_id", "edge_type", "pos"), "pos").alias("e"))
        first = first.join(seen, "node", "left_anti")
        layer = first.select(F.lit(h).alias("layer"), "node", "e.edge_id", "e.src_id", "e.edge_type")
        layers = layer if layers is None else layers.unionByName(layer)
        frontier = first.select("node")
        seen = seen.union(frontier)
    return layers


def recursive_sql(triples: DataFrame, seed: str, k: int) -> DataFrame:
    """Nodes on simple paths of up to k edges, by a recursive query; the set equals ``khop``.

    Paths are enumerated, so this form is for small neighbourhoods: Spark stops
    it with an error beyond ``spark.sql.cteRecursionRowLimit`` rows, and k may
    not exceed ``spark.sql.cteRecursionLevelLimit``. ``khop`` has no such bounds.
    """
    _check_k(k)
    spark = triples.sparkSession
    sql = """
        WITH RECURSIVE walk(node, depth, path) AS (
          SELECT tail, 1, array(:seed, tail) FROM {t} WHERE head = :seed AND tail <> :seed
          UNION ALL
          SELECT e.tail, w.depth + 1, concat(w.path, array(e.tail))
          FROM walk w JOIN {t} e ON e.head = w.node
          WHERE w.depth < :k AND NOT array_contains(w.path, e.tail)
        ) SELECT DISTINCT node FROM walk"""
    distinct = triples.select("head", "tail").distinct()
    return spark.sql(sql, args={"seed": seed, "k": k}, t=distinct)


def trails(edges: DataFrame, seed_rows: DataFrame, least: int, most: int, direction: str = "out") -> DataFrame:
    """(seed, node, length) distinct, of trails from ``least`` to ``most`` edges.

    No edge is used twice; nodes, the seed among them, can come again.
    """
    _check_k(most)
    check_direction(direction)
    e = edges.select(F.col("edge_id").alias("e"), F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    if direction != "out":
        back = e.select("e", F.col("b").alias("a"), F.col("a").alias("b"))
        e = back if direction == "in" else e.union(back.where("a <> b"))
    ensure_checkpoints(edges.sparkSession)
    walk = seed_rows.select("seed", F.col("seed").alias("node")).distinct().withColumn("used", F.array().cast("array<string>"))
    out = None
    for h in range(1, most + 1):
        walk = walk.join(e, F.col("node") == F.col("a")).where(~F.array_contains("used", F.col("e")))
        walk = walk.select("seed", F.col("b").alias("node"), F.array_sort(F.concat("used", F.array("e"))).alias("used"))
        if h > 2:  # trails over the same edges to the same node go on alike
            walk = walk.distinct()
        if h > 3:
            walk = walk.checkpoint()
        if h >= least:
            part = walk.select("seed", "node", F.lit(h).alias("length"))
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def counted_hops(triples: DataFrame, seed_rows: DataFrame, n: int, lookup: Lookup | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Nodes at distance n, and what it took: edge joins, frontiers looked up, and both together. A walk that ends early counts fewer."""
    counted = {"query_count": 0, "take_row_ids_count": 0}
    found = khop(triples, seed_rows, n, lookup=lookup, counted=counted).where(F.col("depth") == n)
    return found, {**counted, "total_operations": sum(counted.values())}


def max_hops(triples: DataFrame, cap: int = 10) -> DataFrame:
    """(node, max_hop): the most edges of a trail from each node, ``cap`` at most; 0 without outgoing edges.

    A walk of h edges starts where an edge leads to the start of one of h - 1,
    so each hop is one semi join over the edges. Walks are trails unless they
    meet a cycle, and those that do reach the cap: only for nodes that do,
    trails are followed, edge by edge.
    """
    spark = triples.sparkSession
    ensure_checkpoints(spark)
    edge = numbered(triples.select(F.col("head").alias("src_id"), F.col("tail").alias("dst_id")), ["src_id", "dst_id"], "edge_id").withColumn("edge_id", F.col("edge_id").cast("string")).checkpoint()
    every = edge.select(F.col("src_id").alias("node")).union(edge.select("dst_id")).distinct()
    step = edge.select(F.col("src_id").alias("node"), F.col("dst_id").alias("next")).distinct()
    able = step.select("node").distinct().checkpoint()
    reach = able.withColumn("h", F.lit(1))
    for h in range(2, cap + 1):
        able = step.join(able.withColumnRenamed("node", "next"), "next", "left_semi").select("node").distinct().checkpoint()
        if able.isEmpty():
            break
        reach = reach.union(able.withColumn("h", F.lit(h)))
    best = reach.groupBy("node").agg(F.max("h").alias("h"))
    far = best.where(F.col("h") == cap).select(F.col("node").alias("seed")).checkpoint()
    if not far.isEmpty():
        walked = trails(edge, far, 1, cap).groupBy(F.col("seed").alias("node")).agg(F.max("length").alias("t"))
        best = best.join(walked, "node", "left").select("node", F.coalesce("t", "h").alias("h"))
    return every.join(best, "node", "left").select("node", F.coalesce("h", F.lit(0)).alias("max_hop"))


def hop_distribution(reach: DataFrame) -> DataFrame:
    """Nodes and percentage by longest hop."""
    total = reach.agg(F.count("*").alias("total"))
    got = reach.groupBy("max_hop").agg(F.count("*").alias("nodes"))
    return got.crossJoin(F.broadcast(total)).select("max_hop", "nodes", F.round(F.col("nodes") * 100.0 / F.col("total"), 6).alias("percentage"))  # one row


def hop_summary(reach: DataFrame) -> DataFrame:
    return reach.agg(F.min("max_hop").alias("least"), F.max("max_hop").alias("most"), F.round(F.avg("max_hop"), 6).alias("mean"), F.percentile("max_hop", F.lit(0.5)).alias("median"))
