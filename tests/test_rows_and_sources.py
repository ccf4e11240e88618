"""Row ids and addresses, filters, file sources and search edge cases."""

import pytest
from pyspark.sql import functions as F

from tessel.functions.numbering import numbered
from tessel.operators import rows, search
from tessel.sources import ldbc, synthetic, tables, triples


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 3).alias("v"))
    got = numbered(df, ["v"]).collect()
    assert sorted((r["row_id"], r["v"]) for r in got) == [(i, 3 * i) for i in range(1000)]
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_row_addresses_over_appends_deletes_and_compaction(spark):
    first, second = (spark.createDataFrame([(i,) for i in part], "id long") for part in ((0, 1, 2), (3, 4, 5)))
    both = rows.addressed([first, second], ["id"])
    assert {r["id"]: r["row_address"] for r in both.collect()} == {0: 0, 1: 1, 2: 2, 3: 1 << 32, 4: (1 << 32) + 1, 5: (1 << 32) + 2}
    left = both.where("id NOT IN (1, 4)")
    assert {(r["fragment"], r["offset"]) for r in rows.decoded(left, "row_address").collect()} == {(0, 0), (0, 2), (1, 0), (1, 2)}
    assert sorted(r["row_address"] for r in rows.compacted(left, 2).collect()) == [(2 << 32) + k for k in range(4)]


def test_takes(spark):
    df = rows.with_row_id(spark.range(20).select(F.col("id").alias("v")), ["v"])
    assert sorted(r["v"] for r in rows.take(df, [3, 3, 5]).collect()) == [3, 5]
    assert [(r["pos"], r["v"]) for r in rows.take_in_order(df, [5, 3, 5]).orderBy("pos").collect()] == [(0, 5), (1, 3), (2, 5)]
    assert rows.take(df, []).count() == 0
    with pytest.raises(IndexError):
        rows.take_offsets(df.select("v"), [20], ["v"])
    assert rows.in_list(df, "v", list(range(2000))).count() == 20
    assert rows.in_list(df, "v", []).count() == 0


def test_predicates(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3)], "k string, n int")
    assert df.where(rows.predicate({})).count() == 2
    assert df.where(rows.predicate({"k": "b", "n": {"$gte": 3}})).count() == 1
    for bad, error in (({"n": {"$ne": 1}}, ValueError), ({"n": {"$gt": "x"}}, TypeError), ({"n": 1.5}, TypeError)):
        with pytest.raises(error):
            rows.predicate(bad)


def test_raw_triples_drop_bad_lines(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("user:a\tlikes\titem:b\n\nonly two\tfields\nplain\tr\tx:y\n1\t2\t3\t4\n")
    got = triples.read_raw(spark, str(tmp_path / "raw.txt"))
    assert sorted(map(tuple, got.collect())) == [("", "plain", "r", "x", "x:y"), ("user", "user:a", "likes", "item", "item:b")]
    (tmp_path / "t.tsv").write_text("head_type\thead\trelation\ttail_type\ttail\n" + "".join(f"u\tu:{i}\tr\tv\tv:{i}\n" for i in range(5)))
    assert [r["head"] for r in triples.read_tsv(spark, str(tmp_path / "t.tsv"), first=2).collect()] == ["u:0", "u:1"]


def test_ragged_files(spark, tmp_path):
    (tmp_path / "person_knows_person_0_0.csv").write_text("Person.id|Person.id|since\n1|2|x\n3|4\n\n5|6|y|z\n")
    got = ldbc.read_ragged(spark, str(tmp_path / "person_knows_person_0_0.csv"))
    assert got.columns == ["row_index", "Person.id__0", "Person.id__1", "since"]
    assert sorted(map(tuple, got.collect())) == [(0, "1", "2", "x"), (1, "3", "4", ""), (2, "5", "6", "y")]
    spec = ldbc.EdgeFile(str(tmp_path / "person_knows_person_0_0.csv"), "knows", "Person", "Person", "Person.id__0", "Person.id__1")
    row = ldbc.read_edges(spark, [spec]).where("src_id = 'Person:1'").first()
    assert (row["edge_id"], row["attrs_json"]) == ("Person:1-knows->Person:2#0", '{"since":"x"}')
    assert ldbc.read_edges(spark, [ldbc.EdgeFile(str(tmp_path / "gone.csv"), "a", "b", "c", "d", "e")]) is None
    info = ldbc.inspect(spark, str(tmp_path)).first()
    assert (info["category"], info["rows"], len(info["columns"])) == ("edge", 3, 3)
    assert ldbc.overview(ldbc.inspect(spark, str(tmp_path))).first()["files"] == 1


def test_catalogue(spark, tmp_path):
    c = tables.Catalogue(spark, str(tmp_path / "db"))
    assert c.list() == []
    with pytest.raises(FileNotFoundError):
        c.open("t")
    df = spark.range(10).select(F.col("id").alias("v"))
    c.create("t", df)
    c.create("t", df, "append")
    assert c.count("t") == 20 and c.exists("t")
    c.compact("t", 1, ["v"])
    assert c.count("t") == 20 and c.storage("t")[0] == 20
    assert [r["v"] for r in c.head("t", 3, ["v"]).collect()] == [0, 0, 1]
    c.drop("t")
    assert not c.exists("t")


def test_json_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1, "b": 2}')
    assert sorted(map(tuple, tables.read_json_map(spark, str(tmp_path / "m.json"), "node_id", "community_id").collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "d.json").write_text('[{"id": "1", "title": "x"},\n {"id": "2", "title": "y"}]')
    assert tables.read_json_rows(spark, str(tmp_path / "d.json")).count() == 2


def test_synthetic_community_edges_stay_inside(spark):
    g = synthetic.graph(spark, 60, 300, relations=8, types=6, mode="community", communities=5, intra_ratio=1.0, seed=11)
    n = lambda c: F.split(c, "node_")[1].cast("int") % 5
    assert g.count() == 300 and g.where(n("head") == n("tail")).count() == 300
    with pytest.raises(ValueError):
        synthetic.graph(spark, 5, 5, mode="ring")
    assert synthetic.documents(spark, 30).select("category").distinct().count() == 3


def test_search_edges(spark):
    docs = spark.createDataFrame([(0, "red fish"), (1, None), (2, "blue fish fish")], "doc_id long, text string")
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["doc_id"] for r in search.keyword_search(docs, "fish").collect()] == [2, 0]
    assert search.keyword_search(docs, "...").count() == 0
    assert [r["vec_id"] for r in search.vector_search(vecs, [1.0, 0.0]).collect()] == [0, 2]
    assert search.fused_search(docs, vecs, "fish", [1.0, 0.0], 1.0, 1).first()["doc_id"] == 0
    with pytest.raises(ValueError):
        search.fused_search(docs, vecs, "fish", [1.0, 0.0], 2.0)
