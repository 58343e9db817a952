import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from kinprint.llm import simhash, trie


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, budget=2):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= budget:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("bits,budget,n", [(64, 2, 300), (32, 3, 400), (12, 3, 300), (8, 2, 200)])
def test_trie_walk_finds_every_pair(bits, budget, n):
    rng = np.random.default_rng(bits + n)
    base = rng.integers(0, 1 << min(bits, 62), n // 4, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, bits, (n, 2)).astype(np.uint64)).sum(axis=1).astype(np.uint64)
    words = np.unique(base[rng.integers(0, len(base), n)] ^ flips)
    if bits < 64:
        words = np.unique(words & np.uint64((1 << bits) - 1))
    want = {(i, j) for i, j in combinations(range(len(words)), 2) if int(words[i] ^ words[j]).bit_count() <= budget}
    got = [(int(i), int(j)) for a, b in trie.self_join(words, bits, budget) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == want


def test_long_runs_expand_in_steps():
    first, count = np.array([0, 7, 9, 10]), np.array([7, 2, 1, 50])
    i, j = np.array([0, 0, 2, 3]), np.array([0, 1, 3, 3])
    want = [
        (a, b)
        for x, y in zip(i, j)
        for a in range(first[x], first[x] + count[x])
        for b in range(first[y], first[y] + count[y])
        if x != y or a < b
    ]
    parts = list(simhash._expanded(i, j, first, count, 16))
    assert [(int(a), int(b)) for p, q in parts for a, b in zip(p, q)] == want
    assert max(len(p) for p, _ in parts) <= 16
    assert not list(simhash._expanded(i[:0], j[:0], first, count))


TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d e f g"), (7, "A b c d e f g"),
    (7, "a b c d e f g"), (8, "word " * 3000), (9, "é\xa0ü x\x1fy " * 40), (None, "a b c d e f g"), (None, "lonely row"),
]


def test_edges_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in TEXTS], "doc_id long, text string, id long, fp int")
    got = simhash.near_duplicates(docs).collect()
    want_prints = [brute_print(t) for _, t in TEXTS]
    want = brute_components([i for i, _ in TEXTS], want_prints)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["id"], r["fp"][0] & (2**64 - 1), r["component"]) for r in got), key=key) == sorted(
        zip([i for i, _ in TEXTS], want_prints, want), key=key
    )


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_real_texts_and_divided_buckets(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], brute_components([r["doc_id"] for r in rows], prints)))
    assert {r["id"]: r["component"] for r in simhash.near_duplicates(docs).collect()} == want
    monkeypatch.setattr(simhash, "HOT", 1)
    assert {r["id"]: r["component"] for r in simhash.near_duplicates(docs).collect()} == want


def test_similar_texts_are_linked_and_others_are_not(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(5000)]
    rows, near = [], {}
    for k in range(40):
        text = list(rng.choice(words, 300))
        rows.append((2 * k, " ".join(text)))
        for at in rng.choice(300, 4, replace=False):
            text[at] = "changed"
        rows.append((2 * k + 1, " ".join(text)))
        near[2 * k + 1] = 2 * k
    got = {r["id"]: r["component"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 2 * k for k in range(40))
    assert sum(got[a] == b for a, b in near.items()) >= 39


def test_recall_at_the_limit(spark):
    """300 pairs at a similarity of just over 0.8: nine of ten are linked at least, and measured far more."""
    rng, rows, exact = np.random.default_rng(9), [], []
    for k in range(300):
        words = [f"v{x}" for x in rng.integers(0, 10**6, 130 + k)]
        other = list(words)
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a, order = shingles(words), rng.permutation(len(words)).tolist()
        while True:
            at, before = order.pop(), list(other)
            other[at] = "changed" + str(at)
            b = shingles(other)
            if 5 * len(a & b) < 4 * len(a | b):
                break
        exact.append(len(a & shingles(before)) / len(a | shingles(before)))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(before))]
    assert np.mean(exact) < 0.82
    got = {r["id"]: r["component"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[2 * k + 1] == 2 * k for k in range(300)]) >= 0.97
    assert all(got[2 * k] == 2 * k for k in range(300))


def test_one_large_group_of_near_copies(spark):
    """All texts differ, in two words each, from one base: no copy is lost, and edges don't follow the pairs."""
    rng = np.random.default_rng(11)
    base, rows = [f"b{k}" for k in range(400)], []
    for k in range(1500):
        text = list(base)
        for at in rng.integers(0, 400, 2):
            text[at] = f"e{k}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = simhash.similar(df).collect()
    assert len(got) == 1500 and sum(r["component"] == 0 for r in got) >= 1495
    assert simhash.keep_one(df).count() <= 6


def test_null_ids_bridge_fingerprints(spark, monkeypatch):
    prints = [(7, 0), (None, 0b11), (9, 0b1111), (5, 0b1111), (5, 1 << 40), (3, 1 << 40), (None, 1 << 20 | 0b11111)]
    made = spark.createDataFrame([(i, [f]) for i, f in prints], "id long, fp array<long>")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: made)
    got = [(r["id"], r["fp"][0], r["component"]) for r in simhash.near_duplicates(made).collect()]
    want = brute_components([i for i, _ in prints], [f for _, f in prints])
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(((i, f, c) for (i, f), c in zip(prints, want)), key=key)


def test_similar_is_exactly_the_components_of_jaccard_0_8(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = np.random.default_rng(5)
    for k in range(300):  # pairs around the limit, on both sides
        words = [f"v{x}" for x in rng.integers(0, 10**6, 150)]
        texts[10**6 + 2 * k] = " ".join(words)
        for at in range(4, 150, 150 // (2 + k % 5)):
            words[at] = "changed"
        texts[10**6 + 2 * k + 1] = " ".join(words)
    owners, sizes = {}, {}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, t in sorted(texts.items()):
        w = (t or "").encode().lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        sizes[d] = len(grams)
        common = {}
        for g in grams:
            for e in owners.get(g, ()):
                common[e] = common.get(e, 0) + 1
            owners.setdefault(g, []).append(d)
        if not grams:
            common = {e: 0 for e in texts if e < d and sizes.get(e) == 0}
        for e, n in common.items():
            if 5 * n >= 4 * (sizes[d] + sizes[e] - n):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar(df).collect()}
    assert got == {d: find(d) for d in texts}


def test_a_phrase_repeated_inside_texts_does_not_link_them(spark):
    rng = np.random.default_rng(6)
    phrase, rows = " ".join(f"p{k}" for k in range(16)), []
    for k in range(40):
        own = [f"d{k}x{x}" for x in rng.integers(0, 10**6, 224)]
        rows.append((k, " ".join([*own[:112], *([phrase] * 12), *own[112:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component"] for r in simhash.similar(df).collect()} == {k: k for k in range(40)}
    assert simhash.keep_one(df).count() == 40
