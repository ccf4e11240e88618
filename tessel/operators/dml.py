"""Changes to triples as functions from table to table; adjacency is derived again from the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("head", "relation", "tail")


def insert(triples: DataFrame, rows: DataFrame, merge: bool = False) -> DataFrame:
    """Appends rows; with ``merge`` only those whose (head, relation, tail) is new."""
    if merge:
        rows = rows.dropDuplicates(list(KEY)).join(triples.select(*KEY).distinct(), list(KEY), "left_anti")
    return triples.unionByName(rows.select(*triples.columns))


def delete(triples: DataFrame, keys: DataFrame) -> DataFrame:
    """Drops every copy of the given (head, relation, tail)."""
    return triples.join(keys.select(*KEY).distinct(), list(KEY), "left_anti").select(*triples.columns)


def update_relation(triples: DataFrame, head: str, relation: str, new: str, tail: str | None = None) -> DataFrame:
    """Renames a relation: of one edge where ``tail`` is given, else of all edges of that head and relation."""
    hit = (F.col("head") == F.lit(head)) & (F.col("relation") == F.lit(relation))
    if tail is not None:
        hit = hit & (F.col("tail") == F.lit(tail))
    return triples.withColumn("relation", F.when(hit, F.lit(new)).otherwise(F.col("relation")))


def upsert(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Updates matching rows in the columns that ``source`` has, and inserts the others.

    Columns that the source lacks keep their values, or are null in new rows.
    """
    s = source.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in source.columns if c != key])
    got = target.join(s, key, "full_outer")
    cols = [F.col(key) if c == key else F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in source.columns else F.col(c) for c in target.columns]
    return got.select(*cols)


def compacted(df: DataFrame, files: int, order: list[str]) -> DataFrame:
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)
