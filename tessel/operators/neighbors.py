"""One-hop neighbour queries, for many seeds in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIONS = ("out", "in", "both")


def check_direction(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}, not {direction!r}")


def seeds(spark: SparkSession, ids: list[str]) -> DataFrame:
    """(seed_pos, seed) in the given order, repeated seeds kept."""
    return spark.createDataFrame(list(enumerate(ids)), "seed_pos int, seed string")


def out_rows(triples: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """Rows that leave ``node``; parallel edges are kept."""
    got = triples.where(F.col("head") == F.lit(node))
    return got if relation is None else got.where(F.col("relation") == F.lit(relation))


def in_rows(triples: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    got = triples.where(F.col("tail") == F.lit(node))
    return got if relation is None else got.where(F.col("relation") == F.lit(relation))


def both_rows(triples: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """Rows that leave, then rows that enter; a self-loop comes twice."""
    out = out_rows(triples, node, relation).withColumn("direction", F.lit("out"))
    return out.unionByName(in_rows(triples, node, relation).withColumn("direction", F.lit("in")))


def rows_of(triples: DataFrame, node: str, direction: str = "out", relation: str | None = None) -> DataFrame:
    check_direction(direction)
    return {"out": out_rows, "in": in_rows, "both": both_rows}[direction](triples, node, relation)


def undirected_rows(merged: DataFrame, node: str) -> DataFrame:
    """Undirected matching on merged edges: an edge comes once, a self-loop as ``out``."""
    got = merged.where((F.col("head") == F.lit(node)) | (F.col("tail") == F.lit(node)))
    leaves = F.col("head") == F.lit(node)
    return got.select(F.when(leaves, "out").otherwise("in").alias("direction"), "relation", F.when(leaves, F.col("tail")).otherwise(F.col("head")).alias("neighbor"))


def index_rows(adjacency: DataFrame, node: str, direction: str = "out") -> DataFrame:
    """Row ids in a node's lists, with their place; an unknown node has none."""
    check_direction(direction)
    mine = adjacency.where(F.col("node_id") == F.lit(node))

    def side(d: str) -> DataFrame:
        return mine.select(F.lit(d).alias("direction"), F.posexplode(f"{d}_neighbor_row_ids").alias("pos", "row_id"))

    return side("out").unionByName(side("in")) if direction == "both" else side(direction)


def materialised(listed: DataFrame, adjacency: DataFrame) -> DataFrame:
    """List entries with the rows they name, repeated as listed; ids without a row are dropped."""
    rows = adjacency.select(F.col("physical_row_id").alias("row_id"), F.col("node_id").alias("neighbor"), F.col("node_type").alias("neighbor_type"), F.col("cluster_id").alias("neighbor_cluster"))
    return listed.join(rows, "row_id")


def batch(triples: DataFrame, seed_rows: DataFrame, direction: str = "out") -> DataFrame:
    """Distinct neighbours per seed, labelled out, in or both; a repeated seed repeats its rows."""
    check_direction(direction)
    wanted = seed_rows.select("seed").distinct()
    sides = []
    if direction != "in":
        sides.append(triples.join(wanted, F.col("head") == F.col("seed")).select("seed", F.col("tail").alias("neighbor"), F.lit(True).alias("o"), F.lit(False).alias("i")))
    if direction != "out":
        sides.append(triples.join(wanted, F.col("tail") == F.col("seed")).select("seed", F.col("head").alias("neighbor"), F.lit(False).alias("o"), F.lit(True).alias("i")))
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    got = rows.groupBy("seed", "neighbor").agg(F.bool_or("o").alias("o"), F.bool_or("i").alias("i"))
    label = F.when(F.col("o") & F.col("i"), "both").when(F.col("o"), "out").when(F.col("i"), "in").otherwise("unknown")
    return got.withColumn("direction", label).join(seed_rows, "seed").select("seed_pos", "seed", "neighbor", "direction")


def batch_rows(triples: DataFrame, seed_rows: DataFrame, direction: str = "out") -> DataFrame:
    """Neighbours per seed with parallel edges kept, as a database join gives them."""
    check_direction(direction)
    wanted = seed_rows.select("seed").distinct()
    out = triples.join(wanted, F.col("head") == F.col("seed")).select("seed", F.col("tail").alias("neighbor"), F.col("tail_type").alias("neighbor_type"))
    into = triples.join(wanted, F.col("tail") == F.col("seed")).select("seed", F.col("head").alias("neighbor"), F.col("head_type").alias("neighbor_type"))
    return {"out": out, "in": into}.get(direction) if direction != "both" else out.unionByName(into)


def batch_distinct(triples: DataFrame, seed_rows: DataFrame, direction: str = "out") -> DataFrame:
    """Neighbours distinct over all seeds together."""
    if seed_rows.isEmpty():
        raise ValueError("a batch needs seeds")
    return batch_rows(triples, seed_rows, direction).select("neighbor").distinct()


def json_rows(adjacency: DataFrame, node: str, direction: str = "out") -> DataFrame:
    """Edges from the JSON lists of a node: direction, relation, neighbor."""
    check_direction(direction)
    mine = adjacency.where(F.col("node_id") == F.lit(node))

    def side(d: str, named: str) -> DataFrame:
        listed = F.from_json(f"{d}_edges", f"array<struct<row_id:bigint,relation:string,{named}:string>>")
        return mine.select(F.inline(listed)).select(F.lit(d).alias("direction"), "relation", F.col(named).alias("neighbor"), "row_id")

    if direction == "both":
        return side("out", "target").unionByName(side("in", "source"))
    return side(direction, "target" if direction == "out" else "source")
