"""The sample graph, a graph with cycles, and a random one against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessel.operators import build, dml, hops, neighbors, stats
from tessel.plans import engine
from tessel.plans.schema import TRIPLES

SAMPLE = [
    ("user", "user:alice", "follows", "user", "user:bob"),
    ("user", "user:alice", "likes", "item", "item:laptop"),
    ("user", "user:bob", "likes", "item", "item:laptop"),
    ("user", "user:bob", "follows", "user", "user:carol"),
    ("user", "user:carol", "likes", "item", "item:camera"),
    ("user", "user:carol", "member_of", "group", "group:ml"),
    ("user", "user:alice", "member_of", "group", "group:ml"),
    ("group", "group:ml", "contains", "topic", "topic:retrieval"),
    ("item", "item:laptop", "belongs_to", "brand", "brand:lenovo"),
    ("item", "item:camera", "belongs_to", "brand", "brand:sony"),
    ("user", "user:dave", "follows", "user", "user:alice"),
]
CYCLE = [("", a, "r", "", b) for a, b in ("ab", "bc", "ca", "aa", "ab")]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(SAMPLE)], "head_type string, head string, relation string, tail_type string, tail string, n int")


@pytest.fixture(scope="module")
def sample_adjacency(sample):
    e = build.edges(sample, ["n"])
    return build.adjacency_index(build.nodes(e), e, build.cluster_by_type()).checkpoint()


def _names(df, column):
    return {r[0].split(":")[1] for r in df.select(column).collect()}


def test_sample_neighbours(sample):
    assert [r["tail"] for r in neighbors.out_rows(sample, "user:alice").orderBy("n").collect()] == ["user:bob", "item:laptop", "group:ml"]
    assert _names(neighbors.in_rows(sample, "user:alice"), "head") == {"dave"}
    assert neighbors.in_rows(sample, "item:laptop").count() == 2
    with pytest.raises(ValueError):
        neighbors.rows_of(sample, "user:alice", "sideways")


def test_sample_hops(spark, sample):
    def hop(node, k, way):
        return _names(hops.khop(sample, neighbors.seeds(spark, [node]), k, way), "node")

    assert hop("user:alice", 2, "out") == {"bob", "laptop", "ml", "carol", "lenovo", "retrieval"}
    assert hop("item:laptop", 2, "in") == {"alice", "bob", "dave"}
    assert hop("user:alice", 1, "both") == {"bob", "laptop", "ml", "dave"}
    assert hop("nobody", 2, "out") == set()
    e = build.edges(sample, ["n"])
    layers = defaultdict(set)
    for r in hops.layered(e, "user:alice", 2).collect():
        layers[r["layer"]].add(r["node"].split(":")[1])
    assert layers == {1: {"bob", "laptop", "ml"}, 2: {"carol", "lenovo", "retrieval"}}
    for bad in (0, "2", True):
        with pytest.raises(ValueError):
            hops.khop(sample, neighbors.seeds(spark, ["user:alice"]), bad)


def test_adjacency_holds_row_ids(sample_adjacency):
    rows = {r["physical_row_id"]: r for r in sample_adjacency.collect()}
    assert sorted(rows) == list(range(10))
    by_name = {r["node_id"]: r for r in rows.values()}
    assert [rows[i]["node_id"] for i in by_name["user:alice"]["out_neighbor_row_ids"]] == ["user:bob", "item:laptop", "group:ml"]
    assert all(len(r["out_neighbor_row_ids"]) == r["degree_out"] and len(r["in_neighbor_row_ids"]) == r["degree_in"] for r in rows.values())
    clusters = [rows[i]["cluster_id"] for i in range(10)]
    assert clusters == sorted(clusters)


def test_materialised_lists_repeat(spark, sample_adjacency):
    got = neighbors.materialised(neighbors.index_rows(sample_adjacency, "user:alice", "both"), sample_adjacency)
    assert {(r["direction"], r["neighbor"]) for r in got.collect()} == {("out", "user:bob"), ("out", "item:laptop"), ("out", "group:ml"), ("in", "user:dave")}
    assert neighbors.index_rows(sample_adjacency, "nobody").count() == 0


def test_cycles_loops_and_parallel_edges(spark):
    t = spark.createDataFrame(CYCLE, TRIPLES)
    e = build.edges(t)
    seed = neighbors.seeds(spark, ["a"])
    node = lambda df: {r["node"] for r in df.collect()}
    assert node(hops.khop(t, seed, 3)) == {"b", "c"}
    assert node(hops.recursive_sql(t, "a", 3)) == {"b", "c"}
    assert node(hops.trails(e, seed, 1, 3)) == {"a", "b", "c"}
    assert node(hops.exact_hops(t, seed, 2)) == {"c"}
    assert node(hops.trails(e, seed, 2, 2)) == {"b", "c"}
    assert sorted(r["tail"] for r in neighbors.out_rows(t, "a").collect()) == ["a", "b", "b"]
    assert neighbors.both_rows(t, "a").count() == 5
    assert {r["neighbor"]: r["direction"] for r in neighbors.batch(t, seed, "both").collect()} == {"a": "both", "b": "out", "c": "in"}
    assert neighbors.batch(t, neighbors.seeds(spark, ["a", "a"]), "out").count() == 4


def test_random_graph_against_python(spark):
    rng = random.Random(5)
    raw = [("t", f"n{rng.randrange(40)}", f"r{rng.randrange(3)}", "t", f"n{rng.randrange(40)}") for _ in range(150)]
    t = spark.createDataFrame(raw, TRIPLES)
    out = defaultdict(set)
    for _, h, _, _, x in raw:
        out[h].add(x)
    for seed in ("n1", "n7"):
        depth, frontier = {seed: 0}, {seed}
        for h in (1, 2, 3):
            frontier = {x for n in frontier for x in out[n]} - set(depth)
            depth |= {n: h for n in frontier}
        want = {n: d for n, d in depth.items() if d}
        assert {r["node"]: r["depth"] for r in hops.khop(t, neighbors.seeds(spark, [seed]), 3).collect()} == want
        assert {r["node"] for r in hops.recursive_sql(t, seed, 3).collect()} == set(want)


def test_large_frontiers_take_the_shuffled_way(spark, sample, monkeypatch):
    monkeypatch.setattr(hops, "LOOKUP", 0)
    monkeypatch.setattr(hops, "BROADCAST", 0)
    got = hops.khop(sample, neighbors.seeds(spark, ["user:alice"]), 2)
    assert _names(got, "node") == {"bob", "laptop", "ml", "carol", "lenovo", "retrieval"}


def test_empty_graph_statistics(spark):
    nodes, edges = build.empty_graph(spark)
    row = stats.graph_stats(nodes, edges).first()
    assert (row["node_count"], row["avg_degree_out"], row["edge_count"]) == (0, 0.0, 0)
    assert stats.dataset_statistics(spark.createDataFrame([], TRIPLES)).first()["entities"] == 0


def test_cluster_rules(spark):
    df = spark.createDataFrame([("a", "user", 1), ("b", "", None)], "node_id string, node_type string, community_id int")
    rows = df.select(build.cluster_by_type().alias("t"), build.cluster_by_community().alias("c"), build.cluster_by_hash(4).alias("h")).collect()
    assert [(r["t"], r["c"]) for r in rows] == [("type::user", "community::1"), ("type::unknown", "community::unknown")]
    with pytest.raises(ValueError):
        build.cluster_by_hash(0)


def test_changes(spark, sample):
    t = sample.drop("n")
    new = spark.createDataFrame([("user", "user:eve", "follows", "user", "user:bob"), SAMPLE[0]], TRIPLES)
    assert dml.insert(t, new).count() == 13
    assert dml.insert(t, new, merge=True).count() == 12
    assert dml.delete(dml.insert(t, new), new.limit(10)).count() == 10
    got = dml.update_relation(t, "user:alice", "follows", "knows")
    assert got.where("relation = 'knows'").count() == 1
    assert dml.update_relation(t, "user:alice", "follows", "knows", "user:carol").where("relation = 'knows'").count() == 0


def test_upsert_keeps_what_the_source_lacks(spark):
    target = spark.createDataFrame([(1, "a", 10, None), (2, "b", 20, "x")], "id long, key string, col_a long, col_b string")
    first = dml.upsert(target, spark.createDataFrame([(1, "B1"), (3, "B3")], "id long, col_b string"))
    assert sorted(map(tuple, first.collect())) == [(1, "a", 10, "B1"), (2, "b", 20, "x"), (3, None, None, "B3")]
    cleared = dml.upsert(first, spark.createDataFrame([(2, None)], "id long, col_a long"))
    assert cleared.where("id = 2").first()["col_a"] is None


def test_engine_runs_all_workloads(spark, sample):
    e = engine.GraphEngine(sample.drop("n"))
    loads = engine.default_workloads(["user:alice"], ["user:alice", "user:bob"])
    got = engine.execute(e, loads, warm_up=0, measured=1).collect()
    assert [r["result_count"] for r in got] == [3, 6, 7, 5]
    assert all(r["success"] for r in got)
    assert engine.matrix(["a"], ["b", "c"], ["d"], [1, 2]) == [("a", "b", "d", 1), ("a", "b", "d", 2), ("a", "c", "d", 1), ("a", "c", "d", 2)]
    row = engine.preview(e.query_k_hop("user:alice", 2), "node", 3).first()
    assert len(row["preview"]) == 3 and row["result_count"] == 6


def test_seed_buckets(spark):
    d = spark.createDataFrame([(f"n{i:02d}", i) for i in range(10)], "node string, degree long")
    got = stats.tercile_seeds(d, 2).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("n")).collect()
    assert {r["bucket"]: r["n"] for r in got} == {"low": ["n00", "n01"], "medium": ["n03", "n04"], "high": ["n06", "n08"]}
    with pytest.raises(ValueError):
        stats.quantile_buckets(d, 0.9, 0.5)
