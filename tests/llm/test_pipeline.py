"""The pipeline's stages on a small corpus."""

import corpus_pipeline
from tessel.llm.common import stored

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, tmp_path):
    """No rows, nulls everywhere, repeated rows, copies with null and equal ids, and columns with the operators' own names."""
    prose = " ".join(f"w{(k * 31) % 997}" for k in range(90))
    other = " ".join(f"v{(k * 17) % 991}" for k in range(90))
    odd = [(4, prose), (4, prose), (9, prose), (None, prose), (None, other), (None, other + " end"), (7, None), (None, None), (8, ""), (4, other + " " + " ".join(f"u{k}" for k in range(150)))]
    rows = [(i, t, None, None, None, "b", "k", 1) for i, t in odd]
    df = spark.createDataFrame(rows, COLUMNS + ", bucket string, key string, times int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got if r["text"]) == sorted([(4, prose), (-1, min(other, other + " end", key=lambda t: [r["h"] for r in spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t) AS h").collect()])), (4, odd[-1][1])])
    assert sum(not r["text"] for r in got) == 3
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
        stage(spark, df, str(tmp_path)).count()


def test_each_stage_takes_effect(spark, tmp_path):
    prose = lambda i, n=120: " ".join(f"w{(i * 131 + k * k * 7 + k) % 4001}" for k in range(n))
    shared = prose(9999, 60)
    docs = [(i, prose(i, 60 + 4 * i)) for i in range(60)]
    docs += [(100 + i, " ".join(f"{w} ###" for w in prose(i + 500).split())) for i in range(40)]
    docs += [(200, prose(1, 64)), (201, prose(70) + " " + shared), (202, prose(80) + " " + shared + " tail"), (203, prose(90) + " password=hunter2222 end"), (204, None), (205, "short text")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in docs[:100]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)))
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda n: {r["doc_id"] for r in seen[n].collect()}
    assert ids("quality_rules") == {*range(60), 200, 201, 202, 203}
    assert ids("near_duplicates") == {*range(60), 201, 202, 203}
    text = {r["doc_id"]: r["text"] for r in seen["repeated_passages"].collect()}
    assert text[202] == prose(80) + " tail" and text[201] == prose(70) + " " + shared and text[5] == prose(5, 80)
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen["secret_scan"].collect()}
    assert clean[203] == (prose(90) + " [ASSIGN] end", len(prose(90) + " [ASSIGN] end"))
    assert seen["best_fit_packing"].select("doc_id").distinct().count() == 63
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["best_fit_packing"].count()
