"""Triples from text files, and from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import type_prefix
from ..functions.numbering import numbered
from ..plans.schema import TRIPLES


def read_tsv(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Tab-separated triples with a header; ``first`` keeps that many rows in file order."""
    df = spark.read.csv(path, sep="\t", header=True, schema=TRIPLES, quote="")
    if first is None:
        return df
    placed = df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__block", F.col("_metadata.file_block_start")).withColumn("__at", F.monotonically_increasing_id())
    return numbered(placed, ["__file", "__block", "__at"], "__row").where(F.col("__row") < first).drop("__file", "__block", "__at", "__row")


def split_raw(lines: DataFrame) -> DataFrame:
    """Lines ``head TAB relation TAB tail`` to triples; lines with another number of fields are dropped."""
    part = F.split("value", "\t", -1)
    ok = lines.where((F.size(part) == 3) & (F.trim("value") != ""))
    return ok.select(type_prefix(part[0]).alias("head_type"), part[0].alias("head"), part[1].alias("relation"), type_prefix(part[2]).alias("tail_type"), part[2].alias("tail"))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return split_raw(spark.read.text(path))


#: relation: (table, head type, head key, tail type, tail key)
STAR = {
    "placed": ("orders", "customer", "o_custkey", "order", "o_orderkey"),
    "contains": ("lineitem", "order", "l_orderkey", "part", "l_partkey"),
    "supplied_by": ("lineitem", "part", "l_partkey", "supplier", "l_suppkey"),
    "supplier_in": ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
    "customer_in": ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
    "part_of": ("nation", "nation", "n_nationkey", "region", "n_regionkey"),
}


def _relation(name: str) -> str:
    return "located_in" if name.endswith("_in") else name


def _keys(ids: list[str], kind: str) -> list[int]:
    out = []
    for x in ids:
        t, _, k = x.partition(":")
        if t == kind and k.lstrip("-").isdigit() and str(int(k)) == k:
            out.append(int(k))
    return out


def star_triples(spark: SparkSession, sf_dir: str, heads: list[str] | None = None, tails: list[str] | None = None) -> DataFrame:
    """The star schema as typed triples.

    With ``heads`` or ``tails``, the ids are turned back into table keys, so the
    filter reaches the Parquet scan and relations without such ids are not read.
    """
    out = None
    for name, (table, ht, hk, tt, tk) in STAR.items():
        src = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(hk).alias("h"), F.col(tk).alias("t"))
        if heads is not None:
            src = src.where(F.col("h").isin(keys)) if (keys := _keys(heads, ht)) else None
        if src is not None and tails is not None:
            src = src.where(F.col("t").isin(keys)) if (keys := _keys(tails, tt)) else None
        if src is None:
            continue
        part = src.select(F.lit(ht).alias("head_type"), _id(ht, "h").alias("head"), F.lit(_relation(name)).alias("relation"), F.lit(tt).alias("tail_type"), _id(tt, "t").alias("tail"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], TRIPLES) if out is None else out


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
