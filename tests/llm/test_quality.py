import duckdb

from kinprint.llm import quality, registry


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.op1_quality_rules(spark, sf)
    cols = got.columns
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL['op1_quality_rules']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edges(spark):
    texts = [None, "", " \n\x0b\r", "a", "a b c a b c", "x y " * 60, "the of and " * 40, "one two\n" * 3, "w " * 3 + "#$%"]
    many = " ".join(f"p{k % 40} q{k % 40} r{k % 40}" for k in range(200))
    rows = [(k, t, k, k) for k, t in enumerate([*texts, many, many])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, __q int, kept int")
    frame, q = quality.with_quality(docs)
    assert frame.columns[:4] == docs.columns
    got = {r["doc_id"]: r[q] for r in frame.collect()}
    assert got[0]["n_words"] == got[1]["n_words"] == got[2]["n_words"] == 0 and got[0]["base_failed"]
    assert got[4]["n_repeat_words"] == 6 and got[3]["n_repeat_words"] == 0
    assert got[5]["n_repeat_words"] == 120 and got[5]["base_failed"]
    assert got[7]["n_dup_lines"] == 2 and got[8]["n_symbols"] == 3
    assert got[9] == got[10] and got[9]["n_repeat_words"] == 600
    assert quality.with_quality(docs.filter("false"))[0].count() == 0
    assert quality.keep_good(docs).columns == docs.columns
