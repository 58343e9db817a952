import numpy as np

from kinprint.llm import decontaminate as dc
from kinprint.llm import registry


def slow_align(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            d = h[i - 1][j - 1] + (dc.MATCH if item[i - 1] == text[j - 1] else -1)
            h[i][j] = max(0, d, h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best / (dc.MATCH * len(item))


def test_alignment_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 30))
        assert abs(dc.align(a, b)[0] - slow_align(a.tolist(), b.tolist())) < 1e-12


def test_real_texts_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = set()
    for r in docs:
        words = dc.words_of(r["text"])
        for i in items:
            w = dc.words_of(i["text"])
            # A quick bound first: no alignment scores more than the item's words that occur.
            if sum(x in set(words) for x in w) >= dc.MIN_SCORE * len(w):
                numbers = {x: k for k, x in enumerate(dict.fromkeys(w))}
                text = np.array([numbers.get(x, -1) for x in words])
                if dc.align(np.array([numbers[x] for x in w]), text)[0] >= dc.MIN_SCORE:
                    want.add((r["doc_id"], i["item_id"]))
    got = registry.op5_decontamination(spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0


def test_edited_copies_edges_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vocab = [f"w{k}" for k in range(4000)]
    items = [(k, " ".join(rng.choice(vocab, 30))) for k in range(20)]
    items += [(90, None), (91, ""), (92, "w1 w2"), (93, "?"), (0, items[0][1])]
    docs, want = [], set()
    for k in range(20):
        text = items[k][1].split()
        for at in (4, 11, 19, 26):
            text[at] = "edited"
        del text[15]
        docs.append((k, " ".join([*rng.choice(vocab, 200), *text, *rng.choice(vocab, 50)]).upper()))
        want.add((k, k))
        docs.append((100 + k, " ".join(rng.choice(vocab, 400))))
    docs += [(200, None), (201, ""), (None, "x " + items[3][1]), (5, docs[10][1]), (202, "w1, W2!"), (203, items[7][1] + " z" * 30_000)]
    want |= {(None, 3), (202, 92), (203, 7)}
    # The passage that leaked into very many documents has no rare seed.
    docs += [(1000 + k, items[9][1]) for k in range(60)]
    want |= {(1000 + k, 9) for k in range(60)}
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 500):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        got = [(r["id"], r["item_id"]) for r in dc.contaminated(df, bench).collect()]
        assert set(got) == want
        assert got.count((5, 5)) == 2 and got.count((0, 0)) == 2
    kept = dc.without_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {200, 201, *range(100, 120)}
    assert dc.contaminated(df.filter("false"), bench).count() == 0
    assert dc.contaminated(df, bench.filter("false")).count() == 0


def test_every_copy_that_the_alignment_accepts_is_found(spark):
    rng = np.random.default_rng(3)
    items, docs, want = [], [], set()
    for k in range(60):
        size = (8, 15, 15, 24, 40)[k % 5]
        items.append((k, " ".join(f"i{k}w{x}" for x in range(size))))
        for c in range(40):  # more copies than a rare seed would have
            text = []
            for w in items[k][1].split():
                u = rng.random()
                text += [f"r{rng.integers(10**9)}"] if u < 0.25 else [] if u < 0.3 else [w, "put"] if u < 0.45 else [w]
            if c < 2:
                text = [y for w in items[k][1].split() for y in (w, "put")][:-1]
            if c == 2 and size == 15:
                text = items[k][1].split()
                for at in (4, 7, 10, 13):
                    text[at - 1] = "edited"
            doc = ["x"] * 30 + text + ["y"] * 30
            numbers = {w: n for n, w in enumerate(items[k][1].split())}
            if dc.align(np.arange(size), np.array([numbers.get(w, -1) for w in doc]))[0] >= dc.MIN_SCORE:
                want.add((100 * k + c, k))
            docs.append((100 * k + c, " ".join(doc)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 1000 and {(r["id"], r["item_id"]) for r in got} == want


def test_rows_are_judged_and_not_ids(spark):
    item = " ".join(f"w{k}" for k in range(30))
    rows = [(None, item), (1, item), (None, "clean text"), (1, "another clean text"), (2, "clean"), (3, None)]
    schema = "__bad long, text string, id map<string,int>, score double, item_id array<string>"
    df = spark.createDataFrame([(i, t, {"a": 1}, 0.5, ["x"]) for i, t in rows], schema)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    kept = dc.without_contaminated(df, bench, id_col="__bad")
    assert kept.schema == df.schema
    assert {(r[0], r[1]) for r in kept.collect()} == {(None, "clean text"), (1, "another clean text"), (2, "clean"), (3, None)}
    assert dc.without_contaminated(df, bench.filter("false")).count() == 6 and dc.without_contaminated(df.filter("false"), bench).count() == 0
