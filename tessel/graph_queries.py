"""Registered graph and search queries over the star-schema tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.expressions import type_prefix
from .functions.numbering import shared_folder
from .operators import build, dml, hops, metrics, neighbors, rows, search, stats
from .plans import engine
from .sources import ldbc, synthetic, tables
from .sources.triples import read_tsv, split_raw, star_triples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CUSTOMER, ORDER, PART, SUPPLIER, NATION = "customer:5", "order:7", "part:7", "supplier:3", "nation:3"
BATCH = ["customer:5", "customer:8", "part:7", "customer:5", "nation:3", "nobody:1"]

TRIPLES = """
  SELECT 'customer' head_type, 'customer:' || o_custkey head, 'placed' relation, 'order' tail_type, 'order:' || o_orderkey tail FROM orders
  UNION ALL SELECT 'order', 'order:' || l_orderkey, 'contains', 'part', 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT 'part', 'part:' || l_partkey, 'supplied_by', 'supplier', 'supplier:' || l_suppkey FROM lineitem
  UNION ALL SELECT 'supplier', 'supplier:' || s_suppkey, 'located_in', 'nation', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer', 'customer:' || c_custkey, 'located_in', 'nation', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'nation', 'nation:' || n_nationkey, 'part_of', 'region', 'region:' || n_regionkey FROM nation"""
EDGES = "SELECT *, row_number() OVER (ORDER BY relation, head, tail) - 1 AS pos FROM triples"
NODES = """
  SELECT node_id, arg_min(node_type, place) AS node_type, sum(o) AS degree_out, sum(i) AS degree_in, min(place) AS node_pos FROM (
    SELECT head node_id, head_type node_type, 2 * pos AS place, 1 AS o, 0 AS i FROM edges
    UNION ALL SELECT tail, tail_type, 2 * pos + 1, 0, 1 FROM edges) GROUP BY node_id"""
ADJACENCY = """
  SELECT n.*, 'type::' || node_type AS cluster_id, row_number() OVER (ORDER BY 'type::' || node_type, node_pos) - 1 AS physical_row_id FROM nodes n"""


def _with(sql: str, *parts: str) -> str:
    known = {"triples": TRIPLES, "edges": EDGES, "nodes": NODES, "adj": ADJACENCY}
    need = {"adj": ("triples", "edges", "nodes", "adj"), "nodes": ("triples", "edges", "nodes"), "edges": ("triples", "edges"), "triples": ("triples",)}
    wanted = [p for p in known if any(p in need[x] for x in (parts or ("triples",)))]
    inner = ", ".join(f"{p} AS ({known[p]})" for p in wanted)
    head, _, tail = sql.strip().partition(" ")
    if head == "WITH":
        recursive = tail.startswith("RECURSIVE ")
        return f"WITH {'RECURSIVE ' * recursive}{inner}, {tail.removeprefix('RECURSIVE ')}"
    return f"WITH {inner} {sql.strip()}"


def query(sql: str | None = None, *parts: str, raw: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql if raw else _with(sql, *parts)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.edges(star_triples(spark, sf_dir), ["relation", "head", "tail"])


def _adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return build.adjacency_index(build.nodes(e), e, build.cluster_by_type())


# --- sources and construction


@query("SELECT head_type, head, relation, tail_type, tail FROM triples")
def triples_scan(spark, sf_dir):
    return star_triples(spark, sf_dir)


@query("SELECT split_part(head, ':', 1) AS head_type, head, relation, split_part(tail, ':', 1) AS tail_type, tail FROM triples")
def triple_type_prefix_split(spark, sf_dir):
    t = star_triples(spark, sf_dir)
    return split_raw(t.select(F.concat_ws("\t", "head", "relation", "tail").alias("value")))


@query("SELECT node_id, node_type, degree_out::BIGINT degree_out, degree_in::BIGINT degree_in, NULL::INT AS community_id, '{}' AS attrs_json FROM nodes", "nodes")
def nodes_table(spark, sf_dir):
    return build.nodes(_edges(spark, sf_dir)).drop("node_pos")


@query("SELECT 'edge_' || pos AS edge_id, head AS src_id, tail AS dst_id, relation AS edge_type, head_type AS src_type, tail_type AS dst_type, '{}' AS attrs_json FROM edges", "edges")
def edges_table(spark, sf_dir):
    return _edges(spark, sf_dir).drop("pos")


_LISTS = """
  SELECT n.node_id, n.node_type, n.cluster_id, n.degree_out::BIGINT degree_out, n.degree_in::BIGINT degree_in, n.physical_row_id,
    coalesce(o.ids, '') AS out_rows, coalesce(i.ids, '') AS in_rows
  FROM adj n
  LEFT JOIN (SELECT e.head, string_agg(a.physical_row_id::VARCHAR, ',' ORDER BY e.pos) ids FROM edges e JOIN adj a ON a.node_id = e.tail GROUP BY 1) o ON o.head = n.node_id
  LEFT JOIN (SELECT e.tail, string_agg(a.physical_row_id::VARCHAR, ',' ORDER BY e.pos) ids FROM edges e JOIN adj a ON a.node_id = e.head GROUP BY 1) i ON i.tail = n.node_id"""


@query(_LISTS, "adj")
def adjacency_index(spark, sf_dir):
    a = _adjacency(spark, sf_dir)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return a.select("node_id", "node_type", "cluster_id", "degree_out", "degree_in", "physical_row_id", text("out_neighbor_row_ids").alias("out_rows"), text("in_neighbor_row_ids").alias("in_rows"))


@query("SELECT 'type::' || node_type AS cluster_id, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def cluster_by_type(spark, sf_dir):
    return build.nodes(_edges(spark, sf_dir)).groupBy(build.cluster_by_type().alias("cluster_id")).agg(F.count("*").alias("n"))


@query("SELECT 'community::' || c_nationkey AS cluster_id, count(*) AS n FROM customer GROUP BY 1", raw=True)
def cluster_by_community(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("community_id"))
    return c.groupBy(build.cluster_by_community().alias("cluster_id")).agg(F.count("*").alias("n"))


@query("SELECT 'hash::' || (('0x' || substr(md5(node_id), 1, 13))::BIGINT % 16) AS cluster_id, count(*) AS n FROM nodes GROUP BY 1", "nodes")
def cluster_by_hash(spark, sf_dir):
    return build.nodes(_edges(spark, sf_dir)).groupBy(build.cluster_by_hash(16).alias("cluster_id")).agg(F.count("*").alias("n"))


@query("SELECT 'default' AS cluster_id, count(*) AS n FROM nodes", "nodes")
def cluster_none(spark, sf_dir):
    return build.nodes(_edges(spark, sf_dir)).groupBy(build.no_cluster().alias("cluster_id")).agg(F.count("*").alias("n"))


@query("SELECT node_id, cluster_id, physical_row_id FROM adj", "adj")
def physical_row_ids(spark, sf_dir):
    e = _edges(spark, sf_dir)
    n = build.nodes(e).withColumn("cluster_id", build.cluster_by_type())
    return rows.with_row_id(n, ["cluster_id", "node_pos"], "physical_row_id").select("node_id", "cluster_id", "physical_row_id")


@query("""SELECT node_id, arg_max(t, place) AS node_type FROM (SELECT head node_id, head_type t, 2 * pos AS place FROM edges UNION ALL SELECT tail, tail_type, 2 * pos + 1 FROM edges) GROUP BY 1""", "edges")
def node_type_last_seen(spark, sf_dir):
    return build.nodes(_edges(spark, sf_dir), last_type=True).select("node_id", "node_type")


@query("""SELECT 'customer:' || c.c_custkey AS node_id, coalesce(o.n, 0) AS degree_out, 0::BIGINT AS degree_in FROM customer c LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""", raw=True)
def degree_enrichment(spark, sf_dir):
    nodes = _table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("node_id"), F.lit("customer").alias("node_type"), F.lit("{}").alias("attrs_json"))
    edges = _table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src_id"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("dst_id"))
    return build.with_degrees(nodes, edges).select("node_id", "degree_out", F.col("degree_in").cast("long").alias("degree_in"))


@query("SELECT head, relation, tail FROM triples GROUP BY ALL")
def edges_merge_dedup(spark, sf_dir):
    return build.merged_edges(star_triples(spark, sf_dir)).select("head", "relation", "tail")


@query("""SELECT 'customer:' || c_custkey AS node_id, c_custkey::VARCHAR AS raw_id,
  '{"c_acctbal":"' || c_acctbal::DECIMAL(18, 2)::VARCHAR || '","c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS attrs_json FROM customer""", raw=True)
def ldbc_style_attrs_json(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("c_acctbal"), "c_mktsegment", "c_name")
    return ldbc.node_rows(c, "customer").select("node_id", "raw_id", "attrs_json")


# --- filters and rows


@query(f"SELECT node_id, node_type FROM nodes WHERE node_id = '{PART}'", "nodes")
def point_lookup(spark, sf_dir):
    n = star_triples(spark, sf_dir, heads=[PART]).select(F.col("head").alias("node_id"), F.col("head_type").alias("node_type")).union(star_triples(spark, sf_dir, tails=[PART]).select("tail", "tail_type"))
    return rows.point(n, "node_id", PART).distinct()


@query(f"SELECT head, relation, tail FROM triples WHERE head = '{CUSTOMER}' AND relation = 'placed'")
def eq_and_filter(spark, sf_dir):
    return rows.equal_all(star_triples(spark, sf_dir, heads=[CUSTOMER]), head=CUSTOMER, relation="placed").select("head", "relation", "tail")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 8, 13, 21)", raw=True)
def in_list_filter(spark, sf_dir):
    return rows.in_list(_table(spark, sf_dir, "customer"), "c_custkey", [5, 8, 13, 21, 8]).select("c_custkey", "c_name")


@query("SELECT head, relation, tail FROM triples WHERE head = 'customer:5' OR head = 'nation:3' ORDER BY head, relation, tail LIMIT 100")
def or_chain_filter(spark, sf_dir):
    ids = ["customer:5", "nation:3"]
    return rows.in_list(star_triples(spark, sf_dir, heads=ids), "head", ids).select("head", "relation", "tail").orderBy("head", "relation", "tail").limit(100)


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 ORDER BY p_size, p_partkey LIMIT 512", raw=True)
def range_filter_limit(spark, sf_dir):
    return rows.half_open(_table(spark, sf_dir, "part"), "p_size", 10, 20).select("p_partkey", "p_size").orderBy("p_size", "p_partkey").limit(512)


@query("SELECT s_suppkey, s_acctbal > 0 AS flag FROM supplier WHERE s_acctbal > 0", raw=True)
def bool_eq_filter(spark, sf_dir):
    return rows.point(_table(spark, sf_dir, "supplier").withColumn("flag", F.col("s_acctbal") > 0), "flag", True).select("s_suppkey", "flag")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars < 3000", raw=True)
def doc_filter_and(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(rows.predicate({"lang": "en", "n_chars": {"$gte": 500, "$lt": 3000}})).select("doc_id", "lang", "n_chars")


_PART_ROWS = "SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part"


@query(f"SELECT * FROM ({_PART_ROWS}) WHERE row_id IN (0, 1, 2, 5, 10, 50)", raw=True)
def take_row_ids(spark, sf_dir):
    return rows.take(rows.with_row_id(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"]), [10, 5, 0, 1, 2, 50, 5])


@query(f"SELECT p_partkey, p_name, row_id AS offset FROM ({_PART_ROWS}) WHERE row_id IN (0, 1, 2, 5, 10)", raw=True)
def take_offsets(spark, sf_dir):
    return rows.take_offsets(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), [0, 1, 2, 5, 10], ["p_partkey"])


@query("SELECT p.pos, t.* FROM (VALUES (0, 10), (1, 5), (2, 5), (3, 0)) p(pos, row_id) JOIN (" + _PART_ROWS + ") t USING (row_id)", raw=True)
def take_in_order(spark, sf_dir):
    return rows.take_in_order(rows.with_row_id(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey"]), [10, 5, 5, 0])


@query("SELECT event_id, (user_id << 32) + (event_id % 1000) AS addr, user_id AS fragment, event_id % 1000 AS offset FROM events", raw=True)
def rowaddr_decode(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", (F.shiftleft("user_id", 32) + F.col("event_id") % 1000).alias("addr"))
    return rows.decoded(e, "addr")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", raw=True)
def ordered_dedup(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return rows.first_of_each(o, "o_custkey", "o_orderkey")


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) WHERE k % greatest(1, n // 20) = 0 AND k // greatest(1, n // 20) < 20""", raw=True)
def evenly_spaced(spark, sf_dir):
    return rows.evenly_spaced(_table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 20)


# --- neighbours


@query(f"SELECT head, relation, tail FROM triples WHERE head = '{CUSTOMER}'")
def out_neighbors(spark, sf_dir):
    return neighbors.out_rows(star_triples(spark, sf_dir, heads=[CUSTOMER]), CUSTOMER).select("head", "relation", "tail")


@query(f"SELECT head, relation, tail FROM triples WHERE head = '{CUSTOMER}' AND relation = 'located_in'")
def out_neighbors_typed(spark, sf_dir):
    return neighbors.out_rows(star_triples(spark, sf_dir, heads=[CUSTOMER]), CUSTOMER, "located_in").select("head", "relation", "tail")


@query(f"SELECT head, relation, tail FROM triples WHERE tail = '{PART}'")
def in_neighbors(spark, sf_dir):
    return neighbors.in_rows(star_triples(spark, sf_dir, tails=[PART]), PART).select("head", "relation", "tail")


def _around(spark, sf_dir, ids):
    return star_triples(spark, sf_dir, heads=ids).unionByName(star_triples(spark, sf_dir, tails=ids))


@query(f"SELECT 'out' AS direction, head, relation, tail FROM triples WHERE head = '{PART}' UNION ALL SELECT 'in', head, relation, tail FROM triples WHERE tail = '{PART}'")
def both_neighbors(spark, sf_dir):
    return neighbors.both_rows(_around(spark, sf_dir, [PART]), PART).select("direction", "head", "relation", "tail")


@query(f"""SELECT CASE WHEN head = '{PART}' THEN 'out' ELSE 'in' END AS direction, relation, CASE WHEN head = '{PART}' THEN tail ELSE head END AS neighbor
  FROM (SELECT DISTINCT head, relation, tail FROM triples) WHERE head = '{PART}' OR tail = '{PART}'""")
def undirected_neighbors_merged(spark, sf_dir):
    return neighbors.undirected_rows(build.merged_edges(_around(spark, sf_dir, [PART])), PART)


@query(f"SELECT 'out' AS direction, row_number() OVER (ORDER BY e.pos) - 1 AS pos, a.physical_row_id AS row_id FROM edges e JOIN adj a ON a.node_id = e.tail WHERE e.head = '{CUSTOMER}'", "adj")
def neighbors_index_only(spark, sf_dir):
    got = neighbors.index_rows(_adjacency(spark, sf_dir), CUSTOMER, "out")
    return got.withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT d AS direction, row_number() OVER (PARTITION BY d ORDER BY pos) - 1 AS pos, a.node_id AS neighbor, a.node_type AS neighbor_type FROM (
  SELECT 'out' d, pos, tail other FROM edges WHERE head = '{PART}' UNION ALL SELECT 'in', pos, head FROM edges WHERE tail = '{PART}') e JOIN adj a ON a.node_id = e.other""", "adj")
def neighbors_materialized(spark, sf_dir):
    a = _adjacency(spark, sf_dir)
    got = neighbors.materialised(neighbors.index_rows(a, PART, "both"), a)
    return got.select("direction", F.col("pos").cast("long").alias("pos"), "neighbor", "neighbor_type")


@query(f"SELECT direction, relation, neighbor FROM (SELECT 'out' AS direction, relation, tail AS neighbor FROM triples WHERE head = '{PART}' UNION ALL SELECT 'in', relation, head FROM triples WHERE tail = '{PART}')")
def neighbors_json(spark, sf_dir):
    t = rows.with_row_id(_around(spark, sf_dir, [PART]), ["relation", "head", "tail"])
    return neighbors.json_rows(build.json_adjacency(t), PART, "both").select("direction", "relation", "neighbor")


_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(BATCH)) + ") v(seed_pos, seed))"


@query(f"WITH {_SEEDS} SELECT DISTINCT seed_pos, seed, tail AS neighbor, 'out' AS direction FROM triples JOIN seeds ON head = seed")
def batch_neighbors_out(spark, sf_dir):
    return neighbors.batch(star_triples(spark, sf_dir, heads=BATCH), neighbors.seeds(spark, BATCH), "out")


@query(f"""WITH {_SEEDS} SELECT seed_pos, seed, neighbor, CASE WHEN max(o) = 1 AND max(i) = 1 THEN 'both' WHEN max(o) = 1 THEN 'out' ELSE 'in' END AS direction FROM (
  SELECT seed_pos, seed, tail neighbor, 1 o, 0 i FROM triples JOIN seeds ON head = seed UNION ALL SELECT seed_pos, seed, head, 0, 1 FROM triples JOIN seeds ON tail = seed) GROUP BY 1, 2, 3""")
def batch_neighbors_both_labeled(spark, sf_dir):
    t = _around(spark, sf_dir, BATCH)
    return neighbors.batch(t, neighbors.seeds(spark, BATCH), "both")


@query(f"WITH {_SEEDS} SELECT DISTINCT tail AS neighbor FROM triples JOIN seeds ON head = seed")
def batch_neighbors_distinct_global(spark, sf_dir):
    return neighbors.batch_distinct(star_triples(spark, sf_dir, heads=BATCH), neighbors.seeds(spark, BATCH), "out")


@query(f"WITH {_SEEDS} SELECT seed, head AS neighbor, head_type AS neighbor_type FROM triples JOIN (SELECT DISTINCT seed FROM seeds) s ON tail = s.seed")
def batch_neighbors_rows_in(spark, sf_dir):
    return neighbors.batch_rows(star_triples(spark, sf_dir, tails=BATCH), neighbors.seeds(spark, BATCH), "in")


# --- hops


def _bfs(seed: str, k: int, direction: str = "out", where: str = "depth > 0") -> str:
    step = {"out": "SELECT head AS a, tail AS b FROM triples", "in": "SELECT tail AS a, head AS b FROM triples", "both": "SELECT head AS a, tail AS b FROM triples UNION SELECT tail, head FROM triples"}[direction]
    return f"""WITH RECURSIVE step AS (SELECT DISTINCT a, b FROM ({step})), w(node, depth) AS (SELECT '{seed}', 0 UNION SELECT s.b, w.depth + 1 FROM w JOIN step s ON s.a = w.node WHERE w.depth < {k}),
      best AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT '{seed}' AS seed, node, depth FROM best WHERE {where}"""


def _lookup(spark, sf_dir):
    return lambda heads, tails: star_triples(spark, sf_dir, heads, tails)


def _khop(seed, k, direction):
    return lambda spark, sf_dir: hops.khop(star_triples(spark, sf_dir), neighbors.seeds(spark, [seed]), k, direction, _lookup(spark, sf_dir))


for _name, _seed, _k, _way in (("khop2_out", CUSTOMER, 2, "out"), ("khop3_out", CUSTOMER, 3, "out"), ("khop2_in", SUPPLIER, 2, "in"), ("khop2_both", CUSTOMER, 2, "both")):
    QUERIES[_name] = _khop(_seed, _k, _way)
    ORACLE_SQL[_name] = _with(_bfs(_seed, _k, _way))


@query(_bfs(CUSTOMER, 3).replace(f"SELECT '{CUSTOMER}' AS seed, node, depth", "SELECT node"))
def khop_recursive_sql(spark, sf_dir):
    return hops.recursive_sql(star_triples(spark, sf_dir), CUSTOMER, 3)


@query(_bfs(CUSTOMER, 2, where="depth = 2"))
def hop_exact2(spark, sf_dir):
    return hops.exact_hops(star_triples(spark, sf_dir), neighbors.seeds(spark, [CUSTOMER]), 2, lookup=_lookup(spark, sf_dir))


@query(_bfs(CUSTOMER, 3, where="depth = 3"))
def hop_exact3(spark, sf_dir):
    found, _ = hops.counted_hops(star_triples(spark, sf_dir), neighbors.seeds(spark, [CUSTOMER]), 3, _lookup(spark, sf_dir))
    return found


@query(f"""WITH RECURSIVE w(node, depth) AS (SELECT '{CUSTOMER}', 0 UNION SELECT tail, depth + 1 FROM w JOIN triples ON head = node WHERE depth < 2), best AS (SELECT node, min(depth) depth FROM w GROUP BY node)
  SELECT b.depth AS layer, e.tail AS node, 'edge_' || min(e.pos) AS edge_id, arg_min(e.head, e.pos) AS src_id, arg_min(e.relation, e.pos) AS edge_type
  FROM edges e JOIN best b ON b.node = e.tail JOIN best f ON f.node = e.head AND f.depth = b.depth - 1 WHERE b.depth > 0 GROUP BY 1, 2""", "edges")
def khop_layered(spark, sf_dir):
    return hops.layered(_edges(spark, sf_dir), CUSTOMER, 2)


@query(f"SELECT DISTINCT '{PART}' AS seed, b.node, 2 AS length FROM (SELECT pos, other AS mid FROM (SELECT pos, tail other FROM edges WHERE head = '{PART}' UNION ALL SELECT pos, head FROM edges WHERE tail = '{PART}')) a JOIN (SELECT pos, head AS mid, tail AS node FROM edges UNION ALL SELECT pos, tail, head FROM edges) b ON a.mid = b.mid AND a.pos <> b.pos", "edges")
def trail_exact2(spark, sf_dir):
    return hops.trails(_edges(spark, sf_dir), neighbors.seeds(spark, [PART]), 2, 2, "both")


@query(_bfs(CUSTOMER, 3).replace(f"SELECT '{CUSTOMER}' AS seed, node, depth FROM best", f"SELECT DISTINCT '{CUSTOMER}' AS seed, node, depth AS length FROM w"))
def trail_up_to3(spark, sf_dir):
    return hops.trails(_edges(spark, sf_dir), neighbors.seeds(spark, [CUSTOMER]), 1, 3)


_REACH = """WITH RECURSIVE step AS (SELECT DISTINCT head a, tail b FROM triples), w(node, h) AS (SELECT b, 0 FROM step WHERE b NOT IN (SELECT a FROM step) UNION SELECT s.a, w.h + 1 FROM w JOIN step s ON s.b = w.node), reach AS (SELECT node, max(h) AS max_hop FROM w GROUP BY node)"""


@query(_REACH + " SELECT max_hop, count(*) AS nodes, round(count(*) * 100.0 / (SELECT count(*) FROM reach), 6)::DOUBLE AS percentage FROM reach GROUP BY 1")
def max_hop_distribution(spark, sf_dir):
    return hops.hop_distribution(hops.max_hops(star_triples(spark, sf_dir)))


@query(_REACH + " SELECT min(max_hop) AS least, max(max_hop) AS most, round(avg(max_hop), 6) AS mean, quantile_cont(max_hop, 0.5)::DOUBLE AS median FROM reach")
def max_hop_summary(spark, sf_dir):
    return hops.hop_summary(hops.max_hops(star_triples(spark, sf_dir)))


# --- statistics


@query(f"SELECT 'out' AS direction, relation, count(*) AS n FROM triples WHERE head = '{CUSTOMER}' GROUP BY 2")
def relation_count_out(spark, sf_dir):
    return stats.relation_counts(star_triples(spark, sf_dir, heads=[CUSTOMER]), CUSTOMER)


@query(f"SELECT 'out' AS direction, relation, count(*) AS n FROM triples WHERE head = '{PART}' GROUP BY 2 UNION ALL SELECT 'in', relation, count(*) FROM triples WHERE tail = '{PART}' GROUP BY 2")
def relation_count_both(spark, sf_dir):
    return stats.relation_counts(_around(spark, sf_dir, [PART]), PART, direction="both")


@query(f"WITH {_SEEDS} SELECT s.seed, coalesce(n, 0) AS n FROM seeds s LEFT JOIN (SELECT head, count(*) n FROM triples GROUP BY 1) t ON t.head = s.seed")
def batch_relation_counts(spark, sf_dir):
    return stats.batch_relation_counts(star_triples(spark, sf_dir, heads=BATCH), neighbors.seeds(spark, BATCH))


@query("SELECT relation, count(*) AS n, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails FROM triples GROUP BY 1")
def relation_statistics(spark, sf_dir):
    return stats.relation_statistics(star_triples(spark, sf_dir))


@query(f"""SELECT * FROM (SELECT 'out' AS direction, relation, tail AS other, count(*) OVER () AS total FROM triples WHERE head = '{NATION}' ORDER BY relation, tail LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'in', relation, head, count(*) OVER () FROM triples WHERE tail = '{NATION}' ORDER BY relation, head LIMIT 20)""")
def entity_relations_topn(spark, sf_dir):
    return stats.entity_relations(_around(spark, sf_dir, [NATION]), NATION, 20)


@query("SELECT (SELECT count(*) FROM triples) AS triples, (SELECT count(DISTINCT head) FROM triples) AS heads, (SELECT count(DISTINCT tail) FROM triples) AS tails, (SELECT count(*) FROM (SELECT head FROM triples UNION SELECT tail FROM triples)) AS entities")
def dataset_totals(spark, sf_dir):
    return stats.dataset_statistics(star_triples(spark, sf_dir))


@query("""SELECT node_type, count(DISTINCT CASE WHEN h THEN node END) AS as_head, count(DISTINCT CASE WHEN NOT h THEN node END) AS as_tail, count(DISTINCT node) AS total
  FROM (SELECT head_type node_type, head node, true h FROM triples UNION ALL SELECT tail_type, tail, false FROM triples) GROUP BY 1""")
def dataset_node_types(spark, sf_dir):
    return stats.node_type_counts(star_triples(spark, sf_dir))


@query("SELECT relation, count(*) AS n FROM triples GROUP BY 1")
def dataset_edge_types(spark, sf_dir):
    return stats.edge_type_counts(star_triples(spark, sf_dir))


@query("""SELECT count(*) AS node_count, count(DISTINCT node_type) AS node_types, round(avg(degree_out), 6) AS avg_degree_out, round(avg(degree_in), 6) AS avg_degree_in,
  (SELECT count(*) FROM triples) AS edge_count, (SELECT count(DISTINCT relation) FROM triples) AS edge_types FROM nodes""", "nodes")
def graph_stats(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return stats.graph_stats(build.nodes(e), e)


@query("""SELECT count(*) AS row_count, round(avg(degree_out), 6) AS avg_degree_out, round(avg(degree_in), 6) AS avg_degree_in, max(degree_out)::BIGINT AS max_degree_out, max(degree_in)::BIGINT AS max_degree_in, count(DISTINCT cluster_id) AS clusters FROM adj""", "adj")
def adjacency_stats(spark, sf_dir):
    return stats.adjacency_stats(_adjacency(spark, sf_dir))


_DEGREE = "degree AS (SELECT node, count(*) AS degree FROM (SELECT head node FROM triples UNION ALL SELECT tail FROM triples) GROUP BY 1)"


@query(f"WITH {_DEGREE} SELECT min(degree) AS least, max(degree) AS most, round(avg(degree), 6) AS mean, quantile_cont(degree, 0.5)::DOUBLE AS median FROM degree")
def degree_distribution(spark, sf_dir):
    return stats.degree_distribution(stats.degrees(star_triples(spark, sf_dir)))


@query(f"WITH {_DEGREE} SELECT node, degree, CASE WHEN degree <= 5 THEN 'low' WHEN degree <= 20 THEN 'medium' ELSE 'high' END AS class FROM degree")
def node_degree_class(spark, sf_dir):
    return stats.node_classes(star_triples(spark, sf_dir))


@query(f"""WITH {_DEGREE} SELECT class, count(*) AS n, sum(degree)::BIGINT AS degrees FROM (SELECT greatest(h.degree, t.degree) AS degree, CASE WHEN greatest(h.degree, t.degree) <= 1 THEN 'isolated' WHEN greatest(h.degree, t.degree) <= 5 THEN 'low' WHEN greatest(h.degree, t.degree) <= 20 THEN 'medium' ELSE 'high' END AS class
  FROM triples JOIN degree h ON h.node = head JOIN degree t ON t.node = tail) GROUP BY 1""")
def triple_degree_class(spark, sf_dir):
    return stats.triple_classes(star_triples(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("n"), F.sum("degree").alias("degrees"))


@query(f"""WITH {_DEGREE}, r AS (SELECT node, row_number() OVER (ORDER BY degree, node) - 1 AS k0, count(*) OVER () AS n FROM degree),
  c AS (SELECT *, greatest(1, n // 3) AS c1, greatest(2, 2 * n // 3) AS c2 FROM r),
  b AS (SELECT node, CASE WHEN k0 < c1 THEN 'low' WHEN k0 < c2 THEN 'medium' ELSE 'high' END AS bucket, k0 - CASE WHEN k0 < c1 THEN 0 WHEN k0 < c2 THEN c1 ELSE c2 END AS k, CASE WHEN k0 < c1 THEN c1 WHEN k0 < c2 THEN c2 - c1 ELSE n - c2 END AS size FROM c)
  SELECT bucket, k // greatest(1, size // 10) AS place, node FROM b WHERE k % greatest(1, size // 10) = 0 AND k // greatest(1, size // 10) < 10""")
def seed_terciles(spark, sf_dir):
    return stats.tercile_seeds(stats.degrees(star_triples(spark, sf_dir)), 10)


@query("""WITH d AS (SELECT o_custkey AS node, count(*) AS degree FROM orders GROUP BY 1), q AS (SELECT quantile_cont(degree, 0.5) AS lo, quantile_cont(degree, 0.9) AS mid FROM d)
  SELECT CASE WHEN degree <= lo THEN 'low' WHEN degree <= mid THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(min(lo), 6)::DOUBLE AS low_cutoff, round(min(mid), 6)::DOUBLE AS mid_cutoff FROM d, q GROUP BY 1""", raw=True)
def seed_quantiles(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("degree"))
    got = stats.quantile_buckets(d)
    return got.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.min("low_cutoff"), 6).alias("low_cutoff"), F.round(F.min("mid_cutoff"), 6).alias("mid_cutoff"))


@query(f"WITH {_DEGREE} SELECT node FROM degree ORDER BY ('0x' || substr(md5(node || '_42'), 1, 13))::BIGINT, node LIMIT 20")
def seed_sample(spark, sf_dir):
    return stats.sampled_seeds(stats.degrees(star_triples(spark, sf_dir)), 20)


@query(f"""WITH r AS (SELECT DISTINCT a.physical_row_id, a.cluster_id FROM edges e JOIN adj a ON a.node_id IN (e.head, e.tail) WHERE e.head = '{CUSTOMER}' OR e.tail = '{NATION}'),
  g AS (SELECT *, lag(cluster_id) OVER (ORDER BY physical_row_id) AS before FROM r)
  SELECT count(*) AS result_count, max(physical_row_id) - min(physical_row_id) AS span, round((max(physical_row_id) - min(physical_row_id)) / (count(*) - 1), 6) AS mean_gap, count(DISTINCT cluster_id) AS clusters,
    round((SELECT max(c) FROM (SELECT count(*) c FROM r GROUP BY cluster_id)) / count(*), 6) AS top_cluster_share, count(*) FILTER (before <> cluster_id) AS cluster_switches FROM g""", "adj")
def locality_metrics(spark, sf_dir):
    t = star_triples(spark, sf_dir, heads=[CUSTOMER]).unionByName(star_triples(spark, sf_dir, tails=[NATION]))
    ids = t.select(F.col("head").alias("node_id")).union(t.select("tail")).distinct()
    return stats.locality(_adjacency(spark, sf_dir).join(ids, "node_id", "left_semi"))


# --- changes


_NEW = "SELECT 'customer' head_type, 'customer:5' head, 'placed' relation, 'order' tail_type, 'order:0' tail UNION ALL SELECT 'customer', 'customer:5', 'likes', 'part', 'part:1'"


def _new(spark):
    return spark.createDataFrame([("customer", "customer:5", "placed", "order", "order:0"), ("customer", "customer:5", "likes", "part", "part:1")], "head_type string, head string, relation string, tail_type string, tail string")


@query(f"SELECT * FROM triples UNION ALL {_NEW}")
def triples_insert(spark, sf_dir):
    return dml.insert(star_triples(spark, sf_dir), _new(spark))


@query("SELECT * FROM triples WHERE NOT (head = 'order:7' AND relation = 'contains') AND NOT (head = 'nation:3')")
def triples_delete(spark, sf_dir):
    keys = star_triples(spark, sf_dir, heads=["order:7", "nation:3"])
    return dml.delete(star_triples(spark, sf_dir), keys)


@query("SELECT head_type, head, CASE WHEN head = 'customer:5' AND relation = 'placed' THEN 'bought' ELSE relation END AS relation, tail_type, tail FROM triples")
def triples_update_head_relation(spark, sf_dir):
    return dml.update_relation(star_triples(spark, sf_dir), "customer:5", "placed", "bought")


@query("SELECT head_type, head, CASE WHEN head = 'nation:3' AND relation = 'part_of' AND tail = 'region:1' THEN 'in' ELSE relation END AS relation, tail_type, tail FROM triples")
def triples_update_exact(spark, sf_dir):
    return dml.update_relation(star_triples(spark, sf_dir), "nation:3", "part_of", "in", "region:1")


def _upsert_tables(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    target = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("key"), F.col("s_nationkey").alias("col_a"), F.lit(None).cast("string").alias("col_b"))
    return target, s.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 6).alias("id"), F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("key"), F.lit(1).alias("col_a"), F.lit("b").alias("col_b"))


_UP_T = "t AS (SELECT s_suppkey id, s_name AS key, s_nationkey col_a, NULL::VARCHAR col_b FROM supplier)"
_UP_S = "s AS (SELECT s_suppkey + 6 AS id, 'new' || s_suppkey AS key, 1 AS col_a, 'b' AS col_b FROM supplier WHERE s_suppkey % 3 = 0)"


@query(f"WITH {_UP_T}, {_UP_S} SELECT * FROM s UNION ALL SELECT * FROM t WHERE id NOT IN (SELECT id FROM s)", raw=True)
def upsert_full(spark, sf_dir):
    return dml.upsert(*_upsert_tables(spark, sf_dir))


@query(f"WITH {_UP_T}, {_UP_S} SELECT coalesce(t.id, s.id) AS id, t.key, t.col_a, s.col_b FROM t FULL JOIN s ON s.id = t.id", raw=True)
def upsert_partial_columns(spark, sf_dir):
    target, source = _upsert_tables(spark, sf_dir)
    return dml.upsert(target, source.select("id", "col_b"))


@query("WITH a AS (SELECT 'nation:' || c_nationkey AS node FROM customer WHERE c_acctbal < 0), b AS (SELECT 'nation:' || s_nationkey AS node FROM supplier WHERE s_acctbal > 5000) SELECT 'left' AS side, node FROM (SELECT node FROM a EXCEPT SELECT node FROM b) UNION ALL SELECT 'right', node FROM (SELECT node FROM b EXCEPT SELECT node FROM a)", raw=True)
def set_difference(spark, sf_dir):
    n = lambda t, c, where: _table(spark, sf_dir, t).where(where).select(F.concat(F.lit("nation:"), F.col(c).cast("string")).alias("node"))
    return metrics.difference(n("customer", "c_nationkey", "c_acctbal < 0"), n("supplier", "s_nationkey", "s_acctbal > 5000"))


# --- search

WORDS = "the tion und"


def _query_vector(spark, sf_dir):
    row = _table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row["embedding"])


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_VECTOR = f"SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT vec_id, score, round(1 - score, 6) AS distance, round(1 - (1 - score) / 2, 6) AS certainty FROM ({_VECTOR}) ORDER BY score DESC, vec_id LIMIT 20", raw=True)
def vector_topk(spark, sf_dir):
    return search.vector_search(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20)


_BM25 = """tok AS (SELECT doc_id, lang, n_chars, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM documents),
  c AS (SELECT doc_id, lang, n_chars, len(t) AS n, len(list_filter(t, lambda w: w = 'the')) AS a, len(list_filter(t, lambda w: w = 'tion')) AS b, len(list_filter(t, lambda w: w = 'und')) AS u FROM tok),
  s AS (SELECT count(*) AS all_n, avg(n) AS mean_n, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (u > 0) AS du FROM c),
  k AS (SELECT doc_id, lang, n_chars,
      ln(1 + (all_n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean_n))
    + ln(1 + (all_n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean_n))
    + ln(1 + (all_n - du + 0.5) / (du + 0.5)) * u * 2.2 / (u + 1.2 * (0.25 + 0.75 * n / mean_n)) AS score FROM c, s WHERE a > 0 OR b > 0 OR u > 0)"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 10", raw=True)
def bm25_topk(spark, sf_dir):
    return search.keyword_search(_table(spark, sf_dir, "documents"), WORDS, 10)


def _fused(alpha: float, where: str = "true", k: int = 10) -> str:
    return f"""WITH {_BM25}, w AS (SELECT doc_id, score FROM k WHERE {where}),
      v AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where}),
      wn AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM w),
      vn AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM v)
      SELECT coalesce(wn.doc_id, vn.doc_id) AS doc_id, round({alpha} * coalesce(vn.x, 0) + {round(1 - alpha, 6)} * coalesce(wn.x, 0), 6) AS score FROM wn FULL JOIN vn ON vn.doc_id = wn.doc_id ORDER BY 2 DESC, 1 LIMIT {k}"""


def _fused_query(alpha: float, where=None):
    return lambda spark, sf_dir: search.fused_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings"), WORDS, _query_vector(spark, sf_dir), alpha, 10, None if where is None else rows.predicate(where))


QUERIES |= {"fused_topk_alpha05": _fused_query(0.5), "fused_topk_alpha07": _fused_query(0.7), "fused_topk_filtered": _fused_query(0.5, {"lang": "en", "n_chars": {"$gte": 500}})}
ORACLE_SQL |= {"fused_topk_alpha05": _fused(0.5), "fused_topk_alpha07": _fused(0.7), "fused_topk_filtered": _fused(0.5, "lang = 'en' AND n_chars >= 500")}


@query(f"""SELECT 'keyword' AS method, * FROM (WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM k ORDER BY 2 DESC, 1 LIMIT 5)
  UNION ALL SELECT 'vector', * FROM (SELECT * FROM ({_VECTOR}) ORDER BY score DESC, vec_id LIMIT 5)
  UNION ALL SELECT 'fused_05', * FROM ({_fused(0.5, k=5)}) UNION ALL SELECT 'fused_07', * FROM ({_fused(0.7, k=5)})""", raw=True)
def search_comparison(spark, sf_dir):
    return search.compare_methods(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "embeddings"), WORDS, _query_vector(spark, sf_dir), 5)


@query("SELECT count(*) AS document_count FROM documents", raw=True)
def object_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("document_count"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey", raw=True)
def reference_join(spark, sf_dir):
    from .sources.tables import with_authors

    docs = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("author_id"))
    who = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department"))
    return with_authors(docs, who).select("o_orderkey", F.col("author_name").alias("c_name"))


# --- measurements: events stand in for result rows


def _results(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.lit("tessel").alias("engine"), F.col("event_type").alias("query_type"), F.col("user_id").cast("string").alias("seed"), (F.col("event_id") % 3 + 1).cast("int").alias("k"), F.lit(None).cast("int").alias("batch_size"),
        F.col("value").alias("time_ms"), (F.col("event_id") % 50).cast("int").alias("result_count"), (F.col("event_id") % 10 != 0).alias("success"), F.lit(None).cast("string").alias("error_message"), (F.col("event_id") % 2).cast("string").alias("seed_group"),
    )


_RES = "r AS (SELECT event_type AS query_type, user_id::VARCHAR AS seed, (event_id % 3 + 1)::INT AS k, value AS time_ms, (event_id % 50)::INT AS result_count, event_id % 10 <> 0 AS success, (event_id % 2)::VARCHAR AS seed_group FROM events)"


@query(f"""WITH {_RES} SELECT query_type, count(*) AS runs, count(DISTINCT seed) AS seeds, round(avg(time_ms), 6) AS mean_ms, round(quantile_cont(time_ms, 0.5), 6) AS median_ms, min(time_ms) AS min_ms, max(time_ms) AS max_ms,
  round(avg(result_count), 6) AS mean_count, min(result_count) AS min_count, max(result_count) AS max_count, round(avg(success::INT), 6) AS success_rate FROM r GROUP BY 1""", raw=True)
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(_results(spark, sf_dir), ["query_type"])


@query(f"""WITH {_RES} SELECT query_type, seed_group, count(*) AS runs, round(avg(time_ms), 6) AS mean_ms, round(quantile_cont(time_ms, 0.5), 6) AS median_ms, round(quantile_cont(time_ms, 0.95), 6) AS p95_ms, min(time_ms) AS min_ms, max(time_ms) AS max_ms
  FROM r WHERE success GROUP BY GROUPING SETS ((query_type, seed_group), (query_type))""", raw=True)
def percentile_linear(spark, sf_dir):
    return metrics.cold_metrics(_results(spark, sf_dir))


@query(f"""WITH {_RES}, o AS (SELECT query_type, count(*) n, sum(time_ms) total, avg(time_ms) mean, list_sort(list(time_ms)) t, avg(result_count) c FROM r GROUP BY 1)
  SELECT query_type, n AS queries, round(total, 6) AS total_ms, round(mean, 6) AS mean_ms, t[round_even(0.5 * (n - 1), 0)::INT + 1] AS p50_ms, t[round_even(0.95 * (n - 1), 0)::INT + 1] AS p95_ms, round(c, 6) AS avg_count, round(n / (total / 1000), 6) AS qps FROM o""", raw=True)
def percentile_nearest_rank(spark, sf_dir):
    return metrics.rank_metrics(_results(spark, sf_dir), ["query_type"])


@query(f"WITH {_RES} SELECT query_type, seed, time_ms FROM r ORDER BY time_ms DESC, query_type, seed LIMIT 10", raw=True)
def slowest_topk(spark, sf_dir):
    return metrics.slowest(_results(spark, sf_dir)).select("query_type", "seed", "time_ms")


@query(f"""WITH {_RES}, g AS (SELECT query_type, avg(time_ms) FILTER (k = 1) AS a, avg(time_ms) FILTER (k = 2) AS b, stddev_samp(time_ms) FILTER (k = 1) AS sa FROM r GROUP BY 1)
  SELECT query_type, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(sa, 6) AS stdev_a, round(a / b, 6) AS speed_up FROM g""", raw=True)
def engine_comparison(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("engine", F.when(F.col("k") == 1, "one").when(F.col("k") == 2, "two").otherwise("three"))
    got = metrics.engine_comparison(r, "one", "two")
    return got.select("query_type", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("stdev_a", 6).alias("stdev_a"), "speed_up")


_RECORD = "'tessel' AS engine, '{}' AS query_type, '{}' AS seed, {} AS k, {} AS batch_size, count(*)::INT AS result_count, true AS success, NULL::VARCHAR AS error_message"


@query(f"""SELECT {_RECORD.format("neighbor", CUSTOMER, "NULL::INT", "NULL::INT")} FROM triples WHERE head = '{CUSTOMER}'
  UNION ALL SELECT {_RECORD.format("k_hop", CUSTOMER, 2, "NULL")} FROM (SELECT tail FROM triples WHERE head = '{CUSTOMER}' UNION SELECT b.tail FROM triples a JOIN triples b ON b.head = a.tail WHERE a.head = '{CUSTOMER}') WHERE tail <> '{CUSTOMER}'
  UNION ALL SELECT {_RECORD.format("batch_neighbor", ",".join(BATCH), "NULL", len(BATCH))} FROM (SELECT DISTINCT seed_pos, tail FROM triples JOIN (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(BATCH))}) v(seed_pos, seed) ON head = seed)""")
def engine_workloads(spark, sf_dir):
    """The three kinds of workload on the engine, as result rows without their times."""
    e = engine.GraphEngine(star_triples(spark, sf_dir))
    return engine.execute(e, [engine.NeighborQuery(CUSTOMER), engine.KHopQuery(CUSTOMER, 2), engine.BatchNeighborQuery(tuple(BATCH))], warm_up=0, measured=1).drop("time_ms")


def _drawn(seed: int) -> str:
    return f"('0x' || substr(md5(id || '_{seed}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"""WITH d AS (SELECT floor({_drawn(8)} * 2000)::BIGINT AS h, floor({_drawn(9)} * 2000)::BIGINT AS t0, floor({_drawn(10)} * 16)::BIGINT AS r, {_drawn(11)} AS inside FROM range(10000) x(id)),
  e AS (SELECT h, r, inside, t0, t0 - t0 % 5 + h % 5 AS n0 FROM d), f AS (SELECT h, r, t0, inside, CASE WHEN n0 < 2000 THEN n0 ELSE n0 - 5 END AS n FROM e),
  g AS (SELECT h, r, CASE WHEN inside < 0.9 AND n >= 0 THEN n ELSE t0 END AS t FROM f)
  SELECT 'type' || (h % 8) AS head_type, 'type' || (h % 8) || ':node_' || h AS head, 'rel_' || r AS relation, 'type' || (t % 8) AS tail_type, 'type' || (t % 8) || ':node_' || t AS tail FROM g""", raw=True)
def synthetic_graph(spark, sf_dir):
    return synthetic.graph(spark, 2000, 10_000, relations=16, types=8, mode="community", communities=5, intra_ratio=0.9, seed=7)


@query("SELECT DISTINCT split_part(head, ':', 1) AS prefix FROM triples")
def type_prefixes(spark, sf_dir):
    return star_triples(spark, sf_dir).select(type_prefix(F.col("head")).alias("prefix")).distinct()


@query(f"WITH {_UP_T.replace('SELECT s_suppkey id', 'SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, s_suppkey id')}, {_UP_S} SELECT t.row_id, coalesce(s.id, t.id) AS id, coalesce(s.key, t.key) AS key, coalesce(s.col_a, t.col_a) AS col_a, coalesce(s.col_b, t.col_b) AS col_b FROM t FULL JOIN s ON s.id = t.id", raw=True)
def stable_row_ids_upsert(spark, sf_dir):
    """Row ids given at the first write stay with their rows through an upsert."""
    target, source = _upsert_tables(spark, sf_dir)
    return dml.upsert(rows.with_row_id(target, ["id"]), source)


@query("""WITH f AS (SELECT s_suppkey AS id, 0 AS fragment, row_number() OVER (ORDER BY s_suppkey) - 1 AS o FROM supplier UNION ALL SELECT c_custkey, 1, row_number() OVER (ORDER BY c_custkey) - 1 FROM customer),
  left_over AS (SELECT id, fragment, (fragment::BIGINT << 32) + o AS old FROM f WHERE id % 3 <> 0)
  SELECT id, fragment, (2::BIGINT << 32) + row_number() OVER (ORDER BY old) - 1 AS row_address FROM left_over""", raw=True)
def compaction_addresses(spark, sf_dir):
    """Two appended fragments, a delete, and the rewrite into a third."""
    first = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0).alias("fragment"))
    second = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("fragment"))
    kept = rows.addressed([first, second], ["id"]).where("id % 3 <> 0")
    return rows.compacted(kept, 2)


@query("SELECT n_regionkey AS community_id, 'community::' || n_regionkey AS cluster_id, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY 1", raw=True)
def cluster_layout(spark, sf_dir):
    """Rows laid out by cluster before a write."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("community_id"), "n_name", F.col("n_nationkey").alias("physical_row_id"))
    laid = build.laid_out(n.withColumn("cluster_id", build.cluster_by_community()), 4)
    return laid.groupBy("community_id", "cluster_id").agg(F.count("*").alias("n"), F.min("n_name").alias("first_name"))


@query("""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY relation, head, tail) - 1 AS row_id FROM triples),
  ends AS (SELECT head AS node_id, head_type AS node_type, row_id, 1 AS o, 0 AS i, '{"row_id":' || row_id || ',"relation":"' || relation || '","target":"' || tail || '"}' AS e FROM numbered
    UNION ALL SELECT tail, tail_type, row_id, 0, 1, '{"row_id":' || row_id || ',"relation":"' || relation || '","source":"' || head || '"}' FROM numbered)
  SELECT node_id, arg_min(node_type, row_id) AS node_type, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree,
    '[' || coalesce(string_agg(CASE WHEN o = 1 THEN e END, ',' ORDER BY row_id), '') || ']' AS out_edges, '[' || coalesce(string_agg(CASE WHEN i = 1 THEN e END, ',' ORDER BY row_id), '') || ']' AS in_edges FROM ends GROUP BY 1""")
def json_adjacency(spark, sf_dir):
    """The JSON adjacency of every node, with the row ids of the whole triple table."""
    return build.json_adjacency(rows.with_row_id(star_triples(spark, sf_dir), ["relation", "head", "tail"]))


@query("SELECT cluster_id, count(*) AS n, min(node_id) AS first_node, 1::BIGINT AS parts, 0::BIGINT AS out_of_order FROM adj GROUP BY 1", "adj")
def cluster_layout_nodes(spark, sf_dir):
    """The node table laid out by cluster before a write: each cluster lies in one part, and its rows in row-id order."""
    laid = build.laid_out(_adjacency(spark, sf_dir), 4).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    before = F.lag("physical_row_id").over(Window.partitionBy("part", "cluster_id").orderBy("at"))
    laid = laid.withColumn("late", F.when(before > F.col("physical_row_id"), 1).otherwise(0))
    return laid.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"), F.countDistinct("part").alias("parts"), F.sum("late").alias("out_of_order"))


@query("""SELECT a.physical_row_id, 'out' AS direction, e.pos // 4096 AS chunk, string_agg(b.physical_row_id::VARCHAR, ',' ORDER BY e.pos) AS ids FROM edges e JOIN adj a ON a.node_id = e.head JOIN adj b ON b.node_id = e.tail GROUP BY 1, 2, 3
  UNION ALL SELECT a.physical_row_id, 'in', e.pos // 4096, string_agg(b.physical_row_id::VARCHAR, ',' ORDER BY e.pos) FROM edges e JOIN adj a ON a.node_id = e.tail JOIN adj b ON b.node_id = e.head GROUP BY 1, 2, 3""", "adj")
def adjacency_chunks(spark, sf_dir):
    """Neighbour lists in bounded pieces, for hubs whose list fits no row."""
    e = _edges(spark, sf_dir)
    got = build.adjacency_chunks(build.nodes(e), e, build.cluster_by_type(), 4096)
    return got.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


_CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("a", "b"), ("c", "d"), ("x", "y")]


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER () AS id, * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _CYCLE) + """) v(s, d)),
  w(origin, node, used, h) AS (SELECT s, d, [id], 1 FROM e UNION ALL SELECT w.origin, e.d, list_append(w.used, e.id), w.h + 1 FROM w JOIN e ON e.s = w.node AND NOT list_contains(w.used, e.id) WHERE w.h < 10)
  SELECT n.node, coalesce(max(w.h), 0)::INT AS max_hop FROM (SELECT s AS node FROM e UNION SELECT d FROM e) n LEFT JOIN w ON w.origin = n.node GROUP BY 1""", raw=True)
def max_hop_cyclic(spark, sf_dir):
    """Longest trails in a small graph with a cycle, a loop and a parallel edge."""
    t = spark.createDataFrame([("n", a, "r", "n", b) for a, b in _CYCLE], "head_type string, head string, relation string, tail_type string, tail string")
    return hops.max_hops(t)


@query("SELECT 3 AS n, count(*) AS nodes, 3 AS query_count, 3 AS take_row_ids_count, 6 AS total_operations FROM (" + _bfs(CUSTOMER, 3, where="depth = 3") + ")", "triples")
def counted_hop3(spark, sf_dir):
    """The counters of an exact three-hop lookup."""
    found, counted = hops.counted_hops(star_triples(spark, sf_dir), neighbors.seeds(spark, [CUSTOMER]), 3, _lookup(spark, sf_dir))
    return found.agg(F.count("*").alias("nodes")).select(F.lit(3).alias("n"), "nodes", *[F.lit(v).alias(k) for k, v in counted.items()])


# --- files: tables written to the shared folder in other formats, and read back


def _folder(spark, name: str) -> str:
    from uuid import uuid4

    return f"{shared_folder(spark)}/tessel-files/{name}-{uuid4().hex}"


@query("SELECT head_type, head, relation, tail_type, tail FROM triples")
def tsv_triples(spark, sf_dir):
    """Triples from tab-separated text with a header."""
    path = _folder(spark, "tsv")
    star_triples(spark, sf_dir).write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False)
    return read_tsv(spark, path)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_index, n_nationkey::VARCHAR AS key__0, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_regionkey::VARCHAR END AS key__1, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS name FROM nation", raw=True)
def ragged_rows(spark, sf_dir):
    """Pipe-separated rows with a repeated name, of which some are short, some long and some blank."""
    path = _folder(spark, "ragged")
    n = _table(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).when(F.col("n_nationkey") % 3 == 1, F.concat_ws("|", "n_nationkey", "n_regionkey", "n_name", F.lit("over"))).otherwise(F.concat_ws("|", "n_nationkey", "n_regionkey", "n_name"))
    body = n.select((F.col("n_nationkey") + 1).alias("at"), line.alias("value")).union(n.where("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 1).alias("at"), F.lit("  ")))
    body.union(spark.createDataFrame([(0, "key|key|name")], "at int, value string")).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return ldbc.read_ragged(spark, path)


@query("SELECT 'customer:' || o_custkey || '-placed->order:' || o_orderkey || '#' || (row_number() OVER (ORDER BY o_orderkey) - 1) AS edge_id, 'customer:' || o_custkey AS src_id, 'order:' || o_orderkey AS dst_id, 'placed' AS edge_type, 'customer' AS src_type, 'order' AS dst_type, '{\"status\":\"' || o_orderstatus || '\"}' AS attrs_json FROM orders", raw=True)
def ldbc_edge_rows(spark, sf_dir):
    """Normalised edges of an edge file, with the other columns as attributes."""
    o = rows.with_row_id(_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("from"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("to"), F.col("o_orderstatus").alias("status")), ["k"], "row_index").drop("k")
    return ldbc.edge_rows(o, ldbc.EdgeFile("", "placed", "customer", "order", "from", "to"))


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_id < 10", raw=True)
def jsonl_rows(spark, sf_dir):
    """Rows appended to JSON lines twice, and read back."""
    path, e = _folder(spark, "jsonl"), _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    tables.append_jsonl(e, path)
    tables.append_jsonl(e.where("event_id < 10"), path)
    return spark.read.schema(e.schema).json(path)


@query(f"WITH {_RES} SELECT 'tessel' AS engine, query_type, seed, k, NULL::INT AS batch_size, time_ms, result_count, success, NULL::VARCHAR AS error_message FROM r", raw=True)
def result_csv(spark, sf_dir):
    """Result records written as CSV with a header and read with their schema."""
    path = _folder(spark, "results")
    tables.write_results(_results(spark, sf_dir).drop("seed_group"), path)
    return tables.read_results(spark, path)


@query("SELECT 'part' AS name, (SELECT count(*) FROM part) AS rows, min(p_partkey) AS first, max(p_partkey) AS last FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5)", raw=True)
def catalogue_table(spark, sf_dir):
    """A table created, appended to, compacted, counted and headed by way of the catalogue."""
    c, p = tables.Catalogue(spark, _folder(spark, "catalogue")), _table(spark, sf_dir, "part").select("p_partkey")
    c.create("gone", p, "overwrite")
    c.create("part", p.where("p_partkey % 2 = 0"), "overwrite", rows_per_file=500)
    c.create("part", p.where("p_partkey % 2 = 1"), "append")
    c.compact("part", 4, ["p_partkey"])
    c.drop("gone")
    head = c.head("part", 5, ["p_partkey"]).agg(F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))
    return head.select(F.lit(",".join(c.list())).alias("name"), F.lit(c.count("part")).cast("long").alias("rows"), "first", "last")


@query(f"SELECT 'doc_' || (id + 1) AS id, 'Document ' || (id + 1) AS title, 'Notes on topic ' || (('0x' || substr(md5(id || '_45'), 1, 13))::BIGINT % 97) AS content, ['Hardware', 'Software', 'Research'][floor({_drawn(42)} * 3)::INT + 1] AS category, (2020 + floor({_drawn(43)} * 5))::INT AS publish_year, 'auth_' || (floor({_drawn(44)} * 50)::BIGINT + 1) AS author_id, '' AS image_url FROM range(1000) x(id)", raw=True)
def synthetic_documents(spark, sf_dir):
    return synthetic.documents(spark)
