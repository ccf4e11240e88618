"""Dense row numbers without a single-task sort."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessel-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share."""
    ensure_checkpoints(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def numbered(df: DataFrame, order: list[str | Column], name: str = "row_id") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given total order.

    Rows are range-partitioned and sorted, the partitions are fixed by a
    checkpoint, and each adds the row counts of those before it; only one
    count per partition reaches the driver.
    """
    spark = df.sparkSession
    ensure_checkpoints(spark)
    fixed = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    at = F.monotonically_increasing_id()
    fixed = fixed.withColumn("__numbered_at", at).withColumn("__numbered_part", F.shiftright("__numbered_at", 33))
    counts = {r["__numbered_part"]: r["n"] for r in fixed.groupBy("__numbered_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    starts = spark.createDataFrame(before or [(0, 0)], "__numbered_part long, __numbered_start long")
    local = F.col("__numbered_at").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.join(F.broadcast(starts), "__numbered_part").withColumn(name, F.col("__numbered_start") + local).drop("__numbered_at", "__numbered_part", "__numbered_start")
