"""Seeded synthetic graphs and documents, generated in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hashed


def drawn(seed: int, key: str = "id") -> Column:
    """A number from 0 to below 1 for each key and seed, the same in any partition and engine."""
    return hashed(F.col(key), F.lit(str(seed))) / F.lit(float(1 << 52))


def graph(spark: SparkSession, nodes: int, edges: int, relations: int = 8, types: int = 4, mode: str = "uniform", communities: int = 4, intra_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Triples between ``nodes`` nodes; mode uniform, powerlaw (small numbers come often) or community."""
    if mode not in ("uniform", "powerlaw", "community"):
        raise ValueError(f"unknown mode {mode!r}")

    def pick(k: int) -> Column:
        r = drawn(seed + k)
        return F.floor((r * r if mode == "powerlaw" else r) * nodes).cast("long")

    df = spark.range(edges).select("id", pick(1).alias("h"), pick(2).alias("t"), F.floor(drawn(seed + 3) * relations).alias("r"), drawn(seed + 4).alias("inside"))
    if mode == "community":
        near = F.col("t") - F.col("t") % communities + F.col("h") % communities  # the same community as the head
        near = F.when(near < nodes, near).otherwise(near - communities)
        df = df.withColumn("t", F.when((F.col("inside") < intra_ratio) & (near >= 0), near).otherwise(F.col("t")))

    def node(c: str) -> Column:
        return F.concat(F.lit("type"), (F.col(c) % types).cast("string"), F.lit(":node_"), F.col(c).cast("string"))

    def kind(c: str) -> Column:
        return F.concat(F.lit("type"), (F.col(c) % types).cast("string"))

    return df.select(kind("h").alias("head_type"), node("h").alias("head"), F.concat(F.lit("rel_"), F.col("r").cast("string")).alias("relation"), kind("t").alias("tail_type"), node("t").alias("tail"))


def community_map(spark: SparkSession, nodes: int, types: int = 4, communities: int = 4) -> DataFrame:
    """(node_id, community_id) of the community mode: node number modulo the communities."""
    n = F.col("id")
    return spark.range(nodes).select(F.concat(F.lit("type"), (n % types).cast("string"), F.lit(":node_"), n.cast("string")).alias("node_id"), (n % communities).cast("int").alias("community_id"))


def documents(spark: SparkSession, n: int = 1000, authors: int = 50, seed: int = 42) -> DataFrame:
    """Generated documents with a category, a year from 2020 to 2024 and an author."""
    kinds = F.array(*[F.lit(x) for x in ("Hardware", "Software", "Research")])
    i = F.col("id") + 1
    return spark.range(n).select(
        F.concat(F.lit("doc_"), i.cast("string")).alias("id"),
        F.concat(F.lit("Document "), i.cast("string")).alias("title"),
        F.concat(F.lit("Notes on topic "), (hashed(F.col("id"), F.lit(str(seed + 3))) % 97).cast("string")).alias("content"),
        F.element_at(kinds, (F.floor(drawn(seed) * 3) + 1).cast("int")).alias("category"),
        (2020 + F.floor(drawn(seed + 1) * 5)).cast("int").alias("publish_year"),
        F.concat(F.lit("auth_"), (F.floor(drawn(seed + 2) * authors) + 1).cast("string")).alias("author_id"),
        F.lit("").alias("image_url"),
    )
