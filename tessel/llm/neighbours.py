"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced partitions, and a
small softmax classifier learns to tell from a vector which partition it and
its neighbours are in. Every row of the table is put in its most probable
partition; a query goes to its several most probable ones and is ranked there
by exact inner products. How many is settled by measuring: a bounded set of
queries is answered by brute force over all rows, in blocks, and the number of
partitions is the least that holds the wanted share of their true neighbours.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part; a null vec_id takes no part; equal
scores go to the smaller vec_id; repeated rows are candidates each; fewer
candidates than wanted are all returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: Bounds of the fitting sample and of the queries that recall is measured on.
SAMPLE, MEASURED = 6000, 200

#: Rows of a partition on average, rows that are ranked at once, and the share of true neighbours wanted.
ROWS_EACH, BLOCK, RECALL = 4096, 4096, 0.95

NEAR = 20


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors that take part."""
    got = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & (F.size("vec") > 0))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    got = got.where(F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0.0))
    most = got.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    return got.join(F.broadcast(most.select("dim")), F.size("vec") == F.col("dim")).select("vec_id", "vec")  # one row


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def balanced_parts(x: np.ndarray, parts: int, near: int = 10, rounds: int = 15, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """Balanced partition of the neighbour graph: seeded by centres, refined by moving nodes to their neighbours' part while there is room."""
    rng = np.random.default_rng(seed)
    n = len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = np.empty((n, min(near, n - 1)), np.int64)
    for a in range(0, n, 1000):
        s = unit[a : a + 1000] @ unit.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        graph[a : a + 1000] = np.argpartition(-s, graph.shape[1] - 1, axis=1)[:, : graph.shape[1]]
    room = int(np.ceil(slack * n / parts))
    centre = unit[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(rounds):
        score = unit @ centre.T
        part = _fill(score, room)
        centre = np.stack([unit[part == k].sum(0) for k in range(parts)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        for c in range(graph.shape[1]):
            np.add.at(votes, (np.arange(n), part[graph[:, c]]), 1.0)
            np.add.at(votes, (graph[:, c], part), 1.0)
        part = _fill(votes + 1e-3 * (unit @ centre.T), room)
    return part


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Each row's best column that has room, the surest rows first."""
    order = np.argsort(-score, axis=1)
    two = np.take_along_axis(score, order[:, :2], 1)
    left = np.full(score.shape[1], room)
    out = np.empty(len(score), np.int64)
    for k in np.argsort(two[:, -1] - two[:, 0], kind="stable").tolist():
        for p in order[k].tolist():
            if left[p]:
                left[p] -= 1
                out[k] = p
                break
    return out


@dataclass
class Router:
    """A softmax classifier from vectors to partitions."""

    weight: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, parts: int, steps: int = 200, rate: float = 2.0, decay: float = 1e-4) -> Router:
        scale = np.sqrt((x**2).sum(1).mean())
        z = x / scale
        w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
        goal = np.eye(parts)[part]
        for _ in range(steps):
            s = z @ w + b
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - goal) / len(z)
            w -= rate * 10 * (z.T @ g + decay * w)
            b -= rate * g.sum(0)
        return cls(w / scale, b)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


def fit(vectors: DataFrame, sample: int = SAMPLE, rows_each: int = ROWS_EACH) -> tuple[Router, int]:
    """A router fitted on at most ``sample`` different vectors, chosen by hash, and the number of rows."""
    n = vectors.count()
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = _matrix(rows.column("vec").combine_chunks()) if rows.num_rows else np.zeros((0, 1))
    x = np.unique(x, axis=0)
    parts = int(max(1, min(len(x) // 40, max(16, -(-n // rows_each)))))
    if parts < 2:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1)), n
    return Router.fit(x, balanced_parts(x, parts), parts), n


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, added up in one order whatever the shapes."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def ranked(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, near: int) -> list[tuple[list[int], list[float]]]:
    """The nearest of a block for each query: largest score first, ties to the smaller id, without the query's own row."""
    s = q @ x.T
    s[qid[:, None] == ids[None, :]] = -np.inf
    k = min(near, len(ids))
    cut = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero((s >= (cut - 1e-9 * (1 + np.abs(np.where(np.isfinite(cut), cut, 0))))[:, None]) & np.isfinite(s))
    exact = inner(q[rows], x[cols])
    order = np.lexsort((ids[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    ends = np.searchsorted(rows, np.arange(len(q) + 1))
    return [(ids[cols[a : min(b, a + near)]].tolist(), exact[a : min(b, a + near)].tolist()) for a, b in zip(ends, ends[1:], strict=False)]


PLACED = "vec_id long, vec array<double>, part int, block int"

#: Queries that one task ranks against one block.
ASKED = 4096
FOUND = "query_id long, ids array<long>, scores array<double>, parts array<int>"


def _blocked(rows: DataFrame, router: Router, blocks: np.ndarray) -> DataFrame:
    """Rows with their partition, and a block of it by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            part = router.scores(_matrix(batch.column(1))).argmax(1) if len(ids) else np.zeros(0, np.int64)
            block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[part]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array(block, pa.int32())], ["vec_id", "vec", "part", "block"])

    return rows.mapInArrow(run, PLACED)


def _asked(queries: DataFrame, router: Router, blocks: np.ndarray, probes: int) -> DataFrame:
    """A row for each block of each query's most probable partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.argsort(-router.scores(_matrix(batch.column(1))), axis=1, kind="stable")[:, :probes]
            take = np.repeat(np.arange(batch.num_rows), blocks[first].sum(1))
            part = np.concatenate([np.repeat(p, blocks[p]) for p in first])
            block = np.concatenate([np.concatenate([np.arange(b) for b in blocks[p]]) for p in first])
            got = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(part, pa.int32()), pa.array(block, pa.int32())], ["vec_id", "vec", "part", "block"])

    return queries.mapInArrow(run, PLACED)


def _met(placed: DataFrame, asked: DataFrame, parts: int, near: int) -> DataFrame:
    """Each block of rows against the queries for it, at most about ASKED of them at once: more queries are split and the block is sent to each part of them."""
    counts = {r["part"]: r["n"] for r in asked.where("block = 0").groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    turns = F.array(*[F.lit(-(-counts.get(p, 0) // ASKED)) for p in range(parts)])  # no turn where nothing is asked
    mine = F.element_at(turns, F.col("part") + 1)
    rows = placed.withColumn("turn", F.explode(F.when(mine > 0, F.sequence(F.lit(0), mine - 1))))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("vec_id"), mine).cast("int"))
    return rows.groupBy("part", "block", "turn").cogroup(asked.groupBy("part", "block", "turn")).applyInArrow(_rank(near), FOUND)


def _rank(near: int):
    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and asked.num_rows:
            ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("vec").combine_chunks())
            part = table.column("part").to_numpy()
            qid, q = asked.column("vec_id").to_numpy(), _matrix(asked.column("vec").combine_chunks())
            where = dict(zip(ids.tolist(), part.tolist(), strict=True))
            for a in range(0, len(qid), 256):
                for k, (got, scores) in enumerate(ranked(qid[a : a + 256], q[a : a + 256], ids, x, near)):
                    out.append((int(qid[a + k]), got, scores, [where[i] for i in got]))
        cols = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()))
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("query_id", "ids", "scores", "parts"), cols, kinds, strict=True)})

    return run


def _merged(found: DataFrame, near: int) -> DataFrame:
    """(query_id, best): the best of all blocks, as structs in order."""
    pairs = F.transform(F.arrays_zip("ids", "scores", "parts"), lambda x: F.struct((-x["scores"]).alias("minus"), x["ids"].alias("vec_id"), x["parts"].alias("part")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, near)
    return found.groupBy("query_id").agg(best.alias("best"))


def search(rows: DataFrame, queries: DataFrame, near: int = NEAR, recall: float = RECALL) -> tuple[DataFrame, float]:
    """(query_id, rank, vec_id, score), with the partitions asked, all partitions and the recall measured on MEASURED queries beside each, and that recall.

    ``queries`` are rows of the same table; a query's own row is no answer.
    """
    spark = rows.sparkSession
    prepare(spark)
    vectors, wanted = stored(usable(rows)), usable(queries)
    router, n = fit(vectors)
    parts = len(router.bias)
    one = np.ones(parts, np.int64)
    sizes = {r["part"]: r["n"] for r in _blocked(vectors, router, one).groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    blocks = np.array([max(1, -(-sizes.get(p, 0) // BLOCK)) for p in range(parts)], np.int64)
    placed = stored(_blocked(vectors, router, blocks))
    probes, measured = parts, 1.0
    if parts > 1:
        test = stored(wanted.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED))
        ranks = _ranks_of_truth(placed, test, router, blocks, near)
        if len(ranks):
            held = np.bincount(ranks, minlength=parts).cumsum() / len(ranks)
            probes = int(np.argmax(held >= recall)) + 1
            measured = float(held[probes - 1])
    asked = _asked(wanted, router, blocks, probes)
    found = _met(placed, asked, parts, near)
    best = _merged(found, near).select("query_id", F.posexplode("best").alias("at", "hit"))
    how = (F.lit(probes).alias("probes"), F.lit(parts).alias("parts"), F.lit(measured).alias("recall"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"), *how), measured


def _ranks_of_truth(placed: DataFrame, test: DataFrame, router: Router, blocks: np.ndarray, near: int) -> np.ndarray:
    """Brute force for the test queries: how far down a query's list of partitions each true neighbour's partition stands."""
    asked = _asked(test, router, blocks, len(router.bias))
    found = _met(placed, asked, len(router.bias), near)
    got = _merged(found, near).join(test, F.col("query_id") == F.col("vec_id")).select("vec", F.transform("best", lambda x: x["part"]).alias("parts")).toArrow()  # at most MEASURED rows
    if not got.num_rows:
        return np.zeros(0, np.int64)
    order = np.argsort(-router.scores(_matrix(got.column("vec").combine_chunks())), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    return np.concatenate([place[k][np.array(p, np.int64)] for k, p in enumerate(got.column("parts").to_pylist()) if p] or [np.zeros(0, np.int64)])
