"""One engine with the adapter interface, workloads, and a runner that records results."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hops, neighbors
from .schema import RESULTS


@dataclass(frozen=True)
class NeighborQuery:
    seed: str
    direction: str = "out"


@dataclass(frozen=True)
class KHopQuery:
    seed: str
    k: int
    direction: str = "out"


@dataclass(frozen=True)
class BatchNeighborQuery:
    seeds: tuple[str, ...]
    direction: str = "out"


Workload = NeighborQuery | KHopQuery | BatchNeighborQuery


def default_workloads(seeds: list[str], batch: list[str]) -> list[Workload]:
    """Per seed one-hop, two-hop and three-hop, and one batch."""
    each = [w for s in seeds for w in (NeighborQuery(s), KHopQuery(s, 2), KHopQuery(s, 3))]
    return [*each, BatchNeighborQuery(tuple(batch))]


class GraphEngine:
    """Neighbour, k-hop and batch queries over one triples frame."""

    def __init__(self, triples: DataFrame, nodes: DataFrame | None = None):
        self.triples, self.nodes = triples, nodes
        self.spark: SparkSession = triples.sparkSession

    def connect(self) -> None:
        self.triples.schema  # noqa: B018  the plan is analysed here

    def close(self) -> None:
        """Nothing is held between queries."""

    def _shown(self, found: DataFrame, column: str, materialise: bool) -> DataFrame:
        if not materialise or self.nodes is None:
            return found
        return found.join(self.nodes.withColumnRenamed("node_id", column), column)

    def query_neighbors(self, seed: str, direction: str = "out", materialise: bool = False) -> DataFrame:
        rows = neighbors.rows_of(self.triples, seed, direction)
        other = F.when(F.col("head") == F.lit(seed), F.col("tail")).otherwise(F.col("head"))
        return self._shown(rows.select(other.alias("neighbor"), "relation"), "neighbor", materialise)

    def query_k_hop(self, seed: str, k: int, direction: str = "out", materialise: bool = False) -> DataFrame:
        return self._shown(hops.khop(self.triples, neighbors.seeds(self.spark, [seed]), k, direction), "node", materialise)

    def query_batch_neighbors(self, seeds: Iterable[str], direction: str = "out", materialise: bool = False) -> DataFrame:
        return self._shown(neighbors.batch(self.triples, neighbors.seeds(self.spark, list(seeds)), direction), "neighbor", materialise)

    def run(self, w: Workload) -> DataFrame:
        if isinstance(w, NeighborQuery):
            return self.query_neighbors(w.seed, w.direction)
        if isinstance(w, KHopQuery):
            return self.query_k_hop(w.seed, w.k, w.direction)
        return self.query_batch_neighbors(w.seeds, w.direction)


def _kind(w: Workload) -> tuple:
    if isinstance(w, NeighborQuery):
        return ("neighbor", w.seed, None, None)
    if isinstance(w, KHopQuery):
        return ("k_hop", w.seed, w.k, None)
    return ("batch_neighbor", ",".join(w.seeds), None, len(w.seeds))


def execute(engine: GraphEngine, workloads: list[Workload], name: str = "tessel", warm_up: int = 1, measured: int = 3, mode: str = "warm") -> DataFrame:
    """Result rows. warm: warm-ups first, one session; coldish: the cache is cleared before each workload; group: before each group of like workloads."""
    if mode not in ("warm", "coldish", "group"):
        raise ValueError(f"unknown mode {mode!r}")
    rows, last = [], None
    for w in workloads:
        kind, seed, k, size = _kind(w)
        group = (kind, k, w.direction, size)
        if mode == "coldish" or (mode == "group" and group != last):
            engine.spark.catalog.clearCache()
        last = group
        for _ in range(warm_up if mode == "warm" else 0):
            engine.run(w).count()
        for _ in range(measured):
            began = time.perf_counter()
            try:
                n, ok, error = engine.run(w).count(), True, None
            except Exception as e:
                n, ok, error = 0, False, str(e)
            rows.append((name, kind, seed, k, size, (time.perf_counter() - began) * 1000, n, ok, error))
    return engine.spark.createDataFrame(rows, RESULTS)


def matrix(single: list[str], batch: list[str], index: list[str], ks: list[int]) -> list[tuple]:
    """Every combination of seed group, batch group, index choice and k."""
    return list(itertools.product(single, batch, index, ks))


def preview(found: DataFrame, column: str, most: int = 24) -> DataFrame:
    """The values of a column as one sorted list, cut to ``most``, with the full count."""
    top = found.select(column).orderBy(column).limit(most)
    return top.agg(F.array_sort(F.collect_list(column)).alias("preview")).crossJoin(found.agg(F.count("*").alias("result_count")))  # one row each
