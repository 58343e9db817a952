import zlib
from collections import Counter

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from kinprint.llm import decontaminate, mixing, quality, registry, simhash
from kinprint.session import table, written

SF = "/root/testdata/sf0.001"


def grams(text, n=5):
    w = simhash_words(text)
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def simhash_words(text):
    return [x.decode() for x in (text or "").encode().lower().split()]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages_against_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    (_, f1), (_, f2), (_, f3), (_, f4), (_, f5) = corpus_pipeline.STAGES

    one = written(f1(spark, docs, SF), "t")
    assert one.columns == docs.columns
    got = {r["doc_id"] for r in one.collect()}
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.oracle_sql()}) WHERE kept").fetchall()}
    assert got == want and 0 < len(got) < len(texts)

    two = written(f2(spark, one, SF), "t")
    assert two.columns == docs.columns
    kept = {r["doc_id"] for r in two.collect()}
    shingles = {d: grams(texts[d]) for d in got}
    assert kept < got
    for d in got - kept:  # what went has a similar text of smaller id
        assert any(e < d and jaccard(shingles[d], shingles[e]) > 0.7 for e in got)
    for d in kept:  # no two that stay are clearly similar
        assert all(e == d or jaccard(shingles[d], shingles[e]) < 0.85 for e in kept)

    three = written(f3(spark, two, SF), "t")
    assert three.columns == docs.columns
    clean = {r["doc_id"] for r in three.collect()}
    items = [decontaminate.words_of(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    for d in kept:
        words = decontaminate.words_of(texts[d])
        best = 0.0
        for item in items:
            if sum(x in set(words) for x in item) >= decontaminate.MIN_SCORE * len(item):
                n = {x: k for k, x in enumerate(dict.fromkeys(item))}
                best = max(best, decontaminate.align(np.array([n[x] for x in item]), np.array([n.get(x, -1) for x in words]))[0])
        assert (d in clean) == (best < decontaminate.MIN_SCORE)

    four = written(f4(spark, three, SF), "t")
    assert four.columns == docs.columns
    copies = Counter(r["doc_id"] for r in four.collect())
    con.execute("CREATE TABLE three AS SELECT doc_id, text, source FROM documents WHERE doc_id IN (SELECT unnest(?))", [sorted(clean)])
    wanted = Counter(r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.oracle_sql('three')})").fetchall())
    assert copies == wanted

    five = sorted(map(tuple, f5(spark, four, SF).collect()), key=lambda r: r[1])
    tok, start = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json")), 0
    assert [r[0] for r in five] == sorted(d for d, n in copies.items() for _ in range(n))
    for d, at, n, crc in five:
        ids = [*tok.encode(texts[d], add_special_tokens=False).ids, 2]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_keep_one_edges(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(5, long), (3, long), (3, long), (3, long + " more"), (None, long), (None, None), (8, ""), (9, None), (10, long.replace("w100", "x"))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(i for i, _ in got) == [3, 8] and dict(got)[3] in (long, long + " more") and dict(got)[8] == ""
    assert simhash.keep_one(df.filter("false")).count() == 0


def test_keep_one_judges_rows_and_not_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (6, b), (None, a), (None, c), (None, c), (7, c + " x"), (9, "own text")]
    schema = "doc_id long, text string, kept_id map<string,int>, __kept_id int, h string, node int, part int"
    df = spark.createDataFrame([(i, t, {"k": 1}, 0, "h", 1, 2) for i, t in rows], schema)
    got = simhash.keep_one(df)
    assert got.schema == df.schema
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(3, a), (5, b), (7, c + " x"), (9, "own text")]
    alone = simhash.keep_one(df.filter("doc_id is null and text like 'c0%'")).collect()
    assert [(r["doc_id"], r["text"], r["kept_id"]) for r in alone] == [(None, c, {"k": 1})]


def test_run_is_the_stages_one_after_another(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "t")
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
