import math
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from kinprint.llm import mixing, registry


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = registry.op4_poisson_mixing(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL['op4_poisson_mixing']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_weights_are_met_and_counts_are_poisson(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'0123456789' as text", "if(id % 4 = 0, 'a', 'b') as source", "1 as copies")
    out, m = mixing.replicate(df, {"a": 1.0, "b": 1.0, "absent": 5.0})
    got = Counter(r["source"] for r in out.collect())
    assert abs(got["a"] - 10000) < 400 and abs(got["b"] - 10000) < 400
    counts = Counter(r[0] for r in out.filter(f"source = 'a' and {m}.copy = 1").select(f"{m}.copies").collect())
    for k in range(1, 6):
        assert abs(counts[k] - 5000 * math.exp(-2) * 2**k / math.factorial(k)) < 150


def test_edges(spark):
    rows = [(1, None, "a"), (1, "xx", "a"), (1, "xx", "a"), (None, "y", None), (3, "", "c"), (4, "z" * 100000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = df.withColumnRenamed("doc_id", "copy")
    out, m = mixing.replicate(wide, epochs=8.0, id_col="copy")
    assert out.columns == [*wide.columns, m]
    keys = Counter((r["copy"], r["text"]) for r in out.collect())
    assert keys[(1, "xx")] == 2 * keys[(1, None)] and keys[(3, "")] == 0
    assert mixing.replicate(df.filter("false"))[0].count() == 0
    many, _ = mixing.replicate(df, epochs=8.0)
    old = mixing.MAX_BROADCAST
    try:
        mixing.MAX_BROADCAST = 0
        salted, _ = mixing.replicate(df, epochs=8.0)
        assert sorted(map(str, salted.collect())) == sorted(map(str, many.collect()))
    finally:
        mixing.MAX_BROADCAST = old


def test_a_tiny_source_meets_its_target(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'0123456789' as text", "if(id < 20, 'tiny', 'big') as source")
    out, m = mixing.replicate(df, {"tiny": 0.5, "big": 0.5})
    got = Counter(r["source"] for r in out.select("source").collect())
    assert abs(got["tiny"] - 10000) < 500 and abs(got["big"] - 10000) < 500  # five deviations of a Poisson sum
    counts = {r[0]: r[1] for r in out.filter("source = 'tiny'").select("doc_id", f"{m}.copies").distinct().collect()}
    assert len(counts) == 20 and len(set(counts.values())) > 10 and all(350 < n < 650 for n in counts.values())


def test_sql_draws_large_rates_in_parts_too(spark):
    rows = [(k, "0123456789", "tiny" if k < 3 else "big") for k in range(30000)] + [(1, "repeated id", "tiny"), (None, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out, m = mixing.replicate(df, shuffle=False)
    got = out.groupBy("doc_id", F.coalesce("source", F.lit("")).alias("source")).count().collect()
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.execute(f"SELECT doc_id, source, count(*) FROM ({mixing.oracle_sql()}) GROUP BY 1, 2").fetchall()
    assert max(r[2] for r in want) > mixing.MAX_RATE
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_clashing_columns_come_back_as_they_were(spark):
    names = ["__mix", "__mix_source", "__mix_u", "__MIX_cdf", "rate", "copies"]
    df = spark.createDataFrame([(k, "text", "en", *names) for k in range(50)], ["doc_id", "text", "source", *names])
    out, m = mixing.replicate(df, epochs=3.0)
    assert out.columns == [*df.columns, m] and m not in df.columns
    assert {tuple(r)[3:-1] for r in out.collect()} == {tuple(names)}
