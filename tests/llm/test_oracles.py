"""Queries of the subpackage against their SQL on the smallest tables and on awkward texts."""

import os

import duckdb
import pytest

from tessel.llm import oracles, queries

DATA = "/root/testdata/sf0.001"


def _awkward(spark, folder):
    passage = " ".join(f"w{i}" for i in range(70))
    texts = [None, "", "  ", "a", "A", passage, "x " + passage, passage.replace("w3 ", "v3 "), passage.upper(), "é😀 token=abc secret=token: abcdefgh", "😀 password = 'hunter22' " + "0a" * 20 + " AKIA" + "B" * 16,
             "secret=abcdef,token:ghijkl", "AKIAAKIA" + "C" * 9 + " api_key=\"zzzzzz", "ghp_" + "a1" * 20 + " xoxb-12345678901", "tab\tsep\nline  a b c d e f", "tab sep line A B C D E F"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return f"{folder}/documents.parquet/*.parquet", folder


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
@pytest.mark.parametrize("awkward", [False, True])
def test_query_equals_its_sql(spark, tmp_path, name, awkward):
    if not awkward and not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    files, folder = _awkward(spark, str(tmp_path)) if awkward else (f"{DATA}/documents.parquet", DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{files}'")
    ran = con.execute(oracles.ORACLE_SQL[name])
    names = [x[0] for x in ran.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(ran.fetchall())
