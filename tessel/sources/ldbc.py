"""Pipe-separated social-network files to normalised nodes and edges."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered


def unique_names(header: list[str]) -> list[str]:
    """Names that come twice get __0, __1, ... in order."""
    many, seen, out = Counter(header), Counter(), []
    for h in header:
        out.append(f"{h}__{seen[h]}" if many[h] > 1 else h)
        seen[h] += 1
    return out


def read_ragged(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Rows as strings with ``row_index``: short rows padded with empty text, long rows cut, blank rows skipped."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    first = text.orderBy("f", "b", "m").first()
    names = unique_names(first["value"].lstrip("﻿").split(sep)) if first else []
    body = numbered(text.where(F.trim("value") != ""), ["f", "b", "m"], "__row").where("__row > 0")
    part = F.split("value", re.escape(sep), -1)
    return body.select((F.col("__row") - 1).alias("row_index"), *[F.coalesce(F.get(part, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


def attrs(columns: list[str]) -> Column:
    """The columns as a JSON object with sorted keys."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])) if columns else F.lit("{}")


def node_rows(rows: DataFrame, kind: str, key: str = "id") -> DataFrame:
    others = [c for c in rows.columns if c not in (key, "row_index")]
    return rows.select(F.concat_ws(":", F.lit(kind), F.col(key)).alias("node_id"), F.lit(kind).alias("node_type"), F.col(key).alias("raw_id"), attrs(others).alias("attrs_json"))


@dataclass(frozen=True)
class EdgeFile:
    """Which columns of an edge file are the ends, and what they are."""

    path: str
    edge_type: str
    src_type: str
    dst_type: str
    src_key: str
    dst_key: str


def edge_rows(rows: DataFrame, spec: EdgeFile) -> DataFrame:
    src = F.concat_ws(":", F.lit(spec.src_type), F.col(f"`{spec.src_key}`"))
    dst = F.concat_ws(":", F.lit(spec.dst_type), F.col(f"`{spec.dst_key}`"))
    others = [c for c in rows.columns if c not in (spec.src_key, spec.dst_key, "row_index")]
    return rows.select(
        F.concat(src, F.lit(f"-{spec.edge_type}->"), dst, F.lit("#"), F.col("row_index").cast("string")).alias("edge_id"),
        src.alias("src_id"), dst.alias("dst_id"), F.lit(spec.edge_type).alias("edge_type"), F.lit(spec.src_type).alias("src_type"), F.lit(spec.dst_type).alias("dst_type"), attrs(others).alias("attrs_json"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_nodes(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Node type to file; missing files are skipped."""
    out = None
    for kind, path in files.items():
        if _exists(spark, path):
            part = node_rows(read_ragged(spark, path), kind)
            out = part if out is None else out.unionByName(part)
    return out


def read_edges(spark: SparkSession, specs: list[EdgeFile]) -> DataFrame:
    out = None
    for spec in specs:
        if _exists(spark, spec.path):
            part = edge_rows(read_ragged(spark, spec.path), spec)
            out = part if out is None else out.unionByName(part)
    return out


def classify(path: Column) -> Column:
    """What a file holds, from its name: node, edge, edge_or_relation, node_or_dimension or unknown."""
    name = F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"(_\d+)*\.csv$", "")
    parts = F.split(name, "_")
    return (
        F.when(F.size(parts) >= 3, "edge")
        .when(F.size(parts) == 2, "edge_or_relation")
        .when(name.isin("person", "comment", "post", "forum", "organisation", "place", "tag", "tagclass"), "node")
        .when(name.rlike("^[a-z]+$"), "node_or_dimension")
        .otherwise("unknown")
    )


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """Each CSV file under a folder with its section, category, columns and rows."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
    lines = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    files = lines.groupBy("path").agg(F.min_by("value", F.struct("b", "m")).alias("header"), (F.count_if(F.trim("value") != "") - 1).alias("rows"))
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("section"), classify(F.col("path")).alias("category"), F.split("header", r"\|").alias("columns"), "rows")


def overview(inspected: DataFrame) -> DataFrame:
    return inspected.groupBy("category").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))
