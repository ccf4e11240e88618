"""Summaries of benchmark result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import shortened


def _timings() -> list:
    return [
        F.count("*").alias("runs"),
        F.countDistinct("seed").alias("seeds"),
        F.round(F.avg("time_ms"), 6).alias("mean_ms"),
        F.round(F.percentile("time_ms", F.lit(0.5)), 6).alias("median_ms"),
        F.min("time_ms").alias("min_ms"),
        F.max("time_ms").alias("max_ms"),
        F.round(F.avg("result_count"), 6).alias("mean_count"),
        F.min("result_count").alias("min_count"),
        F.max("result_count").alias("max_count"),
    ]


def latency_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Timings and counts by ``by``; failed runs are counted in, and ``success_rate`` tells."""
    rate = F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate")
    return results.groupBy(*by).agg(*_timings(), rate)


def slowest(results: DataFrame, n: int = 10) -> DataFrame:
    return results.orderBy(F.desc("time_ms"), "query_type", "seed").limit(n)


def first_errors(results: DataFrame, n: int = 10) -> DataFrame:
    got = results.where(~F.col("success")).orderBy("query_type", "seed").limit(n)
    return got.withColumn("error_message", shortened(F.col("error_message"), 120))


def cold_metrics(results: DataFrame, label: str = "query_type", group: str = "seed_group") -> DataFrame:
    """Mean, median, p95 (linear), least and most of successful runs, by label overall and by group (null: all)."""
    ok = results.where("success")
    got = ok.rollup(label, group).agg(
        F.count("*").alias("runs"), F.round(F.avg("time_ms"), 6).alias("mean_ms"), F.round(F.percentile("time_ms", F.lit(0.5)), 6).alias("median_ms"),
        F.round(F.percentile("time_ms", F.lit(0.95)), 6).alias("p95_ms"), F.min("time_ms").alias("min_ms"), F.max("time_ms").alias("max_ms"), F.grouping_id().alias("__level"),
    )
    return got.where("__level < 3").drop("__level")


def rank_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """Queries, total, mean, nearest-rank p50 and p95, mean count and queries a second."""
    whole, ranked = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("time_ms")
    placed = results.select(*by, "time_ms", "result_count", F.count("*").over(whole).alias("n"), (F.row_number().over(ranked) - 1).alias("at"))
    rank = lambda p: F.max(F.when(F.col("at") == F.bround(F.lit(p) * (F.col("n") - 1)).cast("int"), F.col("time_ms")))
    got = placed.groupBy(*by).agg(F.count("*").alias("queries"), F.sum("time_ms").alias("total"), F.avg("time_ms").alias("mean"), rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"), F.avg("result_count").alias("avg_count"))
    return got.select(
        *by, "queries", F.round("total", 6).alias("total_ms"), F.round("mean", 6).alias("mean_ms"), "p50_ms", "p95_ms",
        F.round("avg_count", 6).alias("avg_count"), F.round(F.when(F.col("total") > 0, F.col("queries") / (F.col("total") / 1000)).otherwise(0.0), 6).alias("qps"),
    )


def engine_comparison(results: DataFrame, base: str, other: str) -> DataFrame:
    """Per query type, both engines' timings with sample deviation, and how many times faster ``other`` is."""
    def of(engine: str, tag: str) -> DataFrame:
        return results.where(F.col("engine") == engine).groupBy("query_type").agg(
            F.avg("time_ms").alias(f"mean_{tag}"), F.percentile("time_ms", F.lit(0.5)).alias(f"median_{tag}"), F.min("time_ms").alias(f"min_{tag}"), F.max("time_ms").alias(f"max_{tag}"), F.stddev_samp("time_ms").alias(f"stdev_{tag}"))

    got = of(base, "a").join(of(other, "b"), "query_type", "full_outer")
    return got.withColumn("speed_up", F.when(F.col("mean_b") > 0, F.round(F.col("mean_a") / F.col("mean_b"), 6)))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one result only, with the side they are on; empty if the sets are equal."""
    left = a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("left"))
    return left.unionByName(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit("right")))
