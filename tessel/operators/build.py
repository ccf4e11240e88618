"""Triples to nodes, edges and adjacency, all set-at-a-time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hashed
from ..functions.numbering import numbered

DEFAULT_TYPE, DEFAULT_CLUSTER = "Entity", "cluster::default"


def normal_type(kind: Column) -> Column:
    return F.when(kind.isNull() | (F.trim(kind) == ""), DEFAULT_TYPE).otherwise(kind)


def edges(triples: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Edges with ``pos`` and ``edge_id`` in the given order of the triples; further columns become ``attrs_json``."""
    extra = sorted(set(triples.columns) - {"head_type", "head", "relation", "tail_type", "tail", "pos"})
    order = order or ["relation", "head", "tail", "head_type", "tail_type"]
    placed = numbered(triples, order, "pos")
    return placed.select(
        "pos",
        F.concat(F.lit("edge_"), F.col("pos").cast("string")).alias("edge_id"),
        F.col("head").alias("src_id"),
        F.col("tail").alias("dst_id"),
        F.col("relation").alias("edge_type"),
        normal_type(F.col("head_type")).alias("src_type"),
        normal_type(F.col("tail_type")).alias("dst_type"),
        (F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra])) if extra else F.lit("{}")).alias("attrs_json"),
    )


def endpoints(edges: DataFrame) -> DataFrame:
    """Two rows per edge: each end with its place in order of appearance, head before tail."""
    ends = F.array(
        F.struct(F.col("src_id").alias("node_id"), F.col("src_type").alias("node_type"), (2 * F.col("pos")).alias("at"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("dst_id").alias("node_id"), F.col("dst_type").alias("node_type"), (2 * F.col("pos") + 1).alias("at"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )
    return edges.select(F.inline(ends))


def nodes(edges: DataFrame, communities: DataFrame | None = None, last_type: bool = False) -> DataFrame:
    """Nodes in one grouping: degrees with parallel edges, type of the first (or last) appearance.

    ``node_pos`` orders nodes by first appearance.
    """
    kind = (F.max_by if last_type else F.min_by)("node_type", "at")
    out = endpoints(edges).groupBy("node_id").agg(kind.alias("node_type"), F.sum("out").alias("degree_out"), F.sum("in").alias("degree_in"), F.min("at").alias("node_pos"))
    if communities is None:
        out = out.withColumn("community_id", F.lit(None).cast("int"))
    else:
        out = out.join(communities.select("node_id", F.col("community_id").cast("int")), "node_id", "left")
    return out.withColumn("attrs_json", F.lit("{}")).select("node_id", "node_type", "degree_out", "degree_in", "community_id", "attrs_json", "node_pos")


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their degrees, 0 for those without edges, and a null community."""
    out = edges.groupBy(F.col("src_id").alias("node_id")).agg(F.count("*").alias("degree_out"))
    into = edges.groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("degree_in"))
    got = nodes.select("node_id", "node_type", "attrs_json").join(out, "node_id", "left").join(into, "node_id", "left")
    return got.select("node_id", "node_type", F.coalesce("degree_out", F.lit(0)).alias("degree_out"), F.coalesce("degree_in", F.lit(0)).alias("degree_in"), F.lit(None).cast("int").alias("community_id"), "attrs_json")


def cluster_by_type(kind: str = "node_type") -> Column:
    return F.concat(F.lit("type::"), F.when(F.col(kind).isNull() | (F.col(kind) == ""), "unknown").otherwise(F.col(kind)))


def cluster_by_hash(buckets: int, node: str = "node_id") -> Column:
    if buckets <= 0:
        raise ValueError("the number of buckets must be positive")
    return F.concat(F.lit("hash::"), (hashed(F.col(node)) % buckets).cast("string"))


def cluster_by_community(community: str = "community_id") -> Column:
    return F.coalesce(F.concat(F.lit("community::"), F.col(community).cast("int").cast("string")), F.lit("community::unknown"))


def no_cluster() -> Column:
    return F.lit("default")


NODE_COLUMNS, EDGE_COLUMNS = ("node_id", "node_type"), ("src_id", "dst_id", "pos")


def _require(df: DataFrame, columns: tuple[str, ...], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lack {', '.join(missing)}")


#: Edge positions to a chunk of a neighbour list, and so its most entries.
CHUNK = 1 << 16


def _placed_ends(nodes: DataFrame, edges: DataFrame, cluster: Column | None) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered by cluster and node order, and two rows for each edge between known nodes: (row, pos, other, out)."""
    _require(nodes, NODE_COLUMNS, "nodes")
    _require(edges, EDGE_COLUMNS, "edges")
    named = nodes.withColumn("cluster_id", F.coalesce(cluster if cluster is not None else F.lit(None), F.lit(DEFAULT_CLUSTER)))
    placed = numbered(named, ["cluster_id", "node_pos"], "physical_row_id")
    row = lambda end: placed.select(F.col("node_id").alias(f"{end}_id"), F.col("physical_row_id").alias(f"{end}_row"))
    known = edges.select("pos", "src_id", "dst_id").join(row("src"), "src_id").join(row("dst"), "dst_id")
    ends = F.array(
        F.struct(F.col("src_row").alias("row"), "pos", F.col("dst_row").alias("other"), F.lit(True).alias("out")),
        F.struct(F.col("dst_row").alias("row"), "pos", F.col("src_row").alias("other"), F.lit(False).alias("out")),
    )
    return placed, known.select(F.inline(ends))


def adjacency_index(nodes: DataFrame, edges: DataFrame, cluster: Column | None = None) -> DataFrame:
    """One row per node with its row id and its neighbours' row ids in edge order, both ways.

    Nodes are numbered once, row ids join the edges once for each end, and one
    grouping makes both lists. Where lists could outgrow a row, use ``adjacency_chunks``.
    """
    placed, ends = _placed_ends(nodes, edges, cluster)
    ids = lambda side: F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("pos", "other")))), lambda x: x["other"])
    lists = ends.groupBy(F.col("row").alias("physical_row_id")).agg(ids(F.col("out")).alias("o"), ids(~F.col("out")).alias("i"))
    none = F.array().cast("array<bigint>")
    got = placed.join(lists, "physical_row_id", "left").withColumn("out_neighbor_row_ids", F.coalesce("o", none)).withColumn("in_neighbor_row_ids", F.coalesce("i", none))
    return got.select("node_id", "node_type", "cluster_id", F.size("out_neighbor_row_ids").cast("long").alias("degree_out"), F.size("in_neighbor_row_ids").cast("long").alias("degree_in"), "attrs_json", "physical_row_id", "out_neighbor_row_ids", "in_neighbor_row_ids")


def adjacency_chunks(nodes: DataFrame, edges: DataFrame, cluster: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """The same lists in pieces: (physical_row_id, direction, chunk, ids), at most ``chunk`` ids each, in edge order.

    A chunk is a range of edge positions, so that a hub's list is made by many tasks and fits any row.
    """
    _, ends = _placed_ends(nodes, edges, cluster)
    named = ends.withColumn("direction", F.when(F.col("out"), "out").otherwise("in")).withColumn("chunk", F.expr(f"pos div {int(chunk)}"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "other"))), lambda x: x["other"])
    return named.groupBy(F.col("row").alias("physical_row_id"), "direction", "chunk").agg(ids.alias("ids"))


def laid_out(adjacency: DataFrame, files: int) -> DataFrame:
    """Rows range-partitioned and sorted by cluster, so that readers of a cluster skip other files."""
    return adjacency.repartitionByRange(files, "cluster_id").sortWithinPartitions("cluster_id", "physical_row_id")


def json_adjacency(triples_with_ids: DataFrame) -> DataFrame:
    """(node_id, node_type, out_edges, in_edges) with edge lists as JSON text; rows carry ``row_id``.

    A node's type is the first that is not null, in row order.
    """
    def ends(me: str, kind: str, other: str, named: str, side: str) -> DataFrame:
        edge = F.struct("row_id", "relation", F.col(other).alias(named))
        return triples_with_ids.select(F.col(me).alias("node_id"), F.col(kind).alias("node_type"), "row_id", F.lit(side).alias("side"), F.to_json(edge).alias("edge"))

    both = ends("head", "head_type", "tail", "target", "out").unionByName(ends("tail", "tail_type", "head", "source", "in"))
    listed = lambda side: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("row_id", "edge")))), lambda x: x["edge"]), ","), F.lit("]"))
    return both.groupBy("node_id").agg(
        F.min_by("node_type", F.when(F.col("node_type").isNotNull(), F.col("row_id"))).alias("node_type"),
        F.sum(F.when(F.col("side") == "out", 1).otherwise(0)).alias("out_degree"),
        F.sum(F.when(F.col("side") == "in", 1).otherwise(0)).alias("in_degree"),
        listed("out").alias("out_edges"),
        listed("in").alias("in_edges"),
    )


def merged_edges(triples: DataFrame) -> DataFrame:
    """Triples as a graph store with merge semantics keeps them: each (head, relation, tail) once."""
    return triples.groupBy("head", "relation", "tail").agg(F.min("head_type").alias("head_type"), F.min("tail_type").alias("tail_type"))


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    from ..plans.schema import EDGES, NODES

    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
