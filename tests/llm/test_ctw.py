import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kinprint.llm import blocks, ctw, registry


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


class SlowTree:
    """One context tree for each decision, by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, Counter()
        self.children = {}
        for data in texts:
            padded = b"\n" * depth + data
            for i in range(depth, len(padded)):
                for j in range(8):
                    prefix, bit = padded[i] >> (8 - j) | 1 << j, padded[i] >> (7 - j) & 1
                    for d in range(depth + 1):
                        ctx = padded[i - d : i]
                        self.n[ctx, prefix, bit] += 1
                        if d:
                            self.children.setdefault((ctx[1:], prefix), set()).add(ctx)
        self.memo = {}

    def parts(self, ctx, prefix):
        if (ctx, prefix) not in self.memo:
            own = kt(self.n[ctx, prefix, 0], self.n[ctx, prefix, 1])
            if len(ctx) == self.depth:
                self.memo[ctx, prefix] = own, 0.0, own
            else:
                split = sum(self.parts(c, prefix)[2] for c in sorted(self.children.get((ctx, prefix), ())))
                self.memo[ctx, prefix] = own, split, np.logaddexp(own, split) - math.log(2)
        return self.memo[ctx, prefix]

    def p(self, padded, i, prefix, bit, d=0):
        ctx = padded[i - d : i]
        a, b = self.n[ctx, prefix, 0], self.n[ctx, prefix, 1]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        deeper = self.p(padded, i, prefix, bit, d + 1)
        o, s, _ = self.parts(ctx, prefix)
        w = 1 / (1 + math.exp(min(700, max(-700, s - o))))
        return w * own + (1 - w) * deeper

    def score(self, data):
        padded, total = b"\n" * self.depth + data, 0.0
        for i in range(self.depth, len(padded)):
            for j in range(8):
                total += math.log10(self.p(padded, i, padded[i] >> (8 - j) | 1 << j, padded[i] >> (7 - j) & 1))
        return total


def tokens(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute(rows, depth):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    data = [" ".join(tokens(t)).encode() + b"\n" for _, t in rows]
    tree = SlowTree([d for d, h in zip(data, held) if not h], depth)
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in [*tokens(t), "\n"])
    total, v = sum(c.values()), len(c)
    out = []
    for (i, t), h, d in zip(rows, held, data):
        words = [*tokens(t), "\n"]
        base = sum(math.log10((c[w] + 1) / (total + v + 1)) for w in words)
        out.append((i, h, len(words), sum(c[w] > 0 for w in words), total, base, tree.score(d)))
    return out


WORDS = "the cat sat on a mat and Then that chat Ümlaut naïve 日本 x\xa0y !! 12".split(" ")


def check(spark, rows, depth):
    df = spark.createDataFrame([(i, t, 0, "n") for i, t in rows], "doc_id long, text string, id int, held string")
    got = ctw.score(df, depth=depth).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows, depth), key=key)
    got = sorted([tuple(r)[:7] for r in got], key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)


@pytest.mark.parametrize("depth", [4, 5, 6])
def test_against_brute_force(spark, depth):
    rng = np.random.default_rng(depth)
    rows = [(k, " ".join(rng.choice(WORDS, rng.integers(1, 30)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (None, "the cat"), (3, rows[3][1]), (103, "zzz unseen qqq")]
    check(spark, rows, depth)


def test_one_hot_context(spark):
    """Most grams follow one context of ``SHARED`` bytes; some texts are longer than many others together."""
    rng = np.random.default_rng(1)
    rows = [(k, "aaa" * int(rng.integers(1, 40)) + " aaab aaac"[: k % 11]) for k in range(60)] + [(200, "aaa x " * 700)]
    check(spark, rows, 6)


def test_no_training_rows_and_empty_table(spark):
    held = [k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    check(spark, [(k, "only held out words") for k in held], 4)
    assert ctw.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keys_of_chunks_and_batches(monkeypatch):
    """Keys by windows, whatever the chunks, are those of the bytes before and the byte itself."""
    texts = [b"", b"ab", "na\u00efve w".encode(), b"x" * 30, b"\xff\xfe"]
    for depth in (4, 6):
        want = []
        for k, t in enumerate(texts):
            padded = b"\n" * depth + t + b"\n"
            want += [(int.from_bytes(padded[i - depth : i][::-1] + padded[i : i + 1], "big"), k) for i in range(depth, len(padded))]
        for chunk in (1, 7, 1 << 20):
            monkeypatch.setattr(ctw, "CHUNK", chunk)
            assert [(int(a), int(b)) for key, text in ctw.grams(texts, depth) for a, b in zip(key, text)] == want


def test_slices_keep_groups_together(monkeypatch):
    monkeypatch.setattr(ctw, "SLICE", 5)
    key = np.sort(np.random.default_rng(2).integers(0, 2**20, 200).astype(np.uint64) << np.uint64(24))
    parts = list(ctw.slices(key, 6))
    assert np.concatenate([key[p] for p in parts]).tolist() == key.tolist()
    groups = [set(ctw.near(key[p], 6).tolist()) for p in parts]
    assert sum(map(len, groups)) == len(set.union(*groups))


def test_packing():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    for k in (keys, keys[:1], keys[:0]):
        assert (blocks.unpack(blocks.pack(k)) == k).all()


def test_probabilities_sum_to_one():
    data = b"abracadabra abracadabra"
    key, n = np.unique(np.concatenate([k for k, _ in ctw.grams([data], 4)]), return_counts=True)
    every = (key[5] >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    whole = np.union1d(key, every)
    count = np.zeros(len(whole), np.int64)
    count[np.searchsorted(whole, key)] = n
    trees = ctw.Trees(whole, count, 4, ctw.SHARED)
    node, *sums = trees.summary()
    p = trees.log10_probability(ctw.tops(ctw.parent(node), *sums, ctw.SHARED - 1))
    assert (10 ** p[np.searchsorted(whole, every)]).sum() == pytest.approx(1)


def test_query_has_the_base_columns_of_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(w for i, t in docs.items() if not held[i] for w in [*tokens(t), "\n"])
    total, v = sum(c.values()), len(c)
    got = registry.op2_context_tree(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        words = [*tokens(docs[r["doc_id"]]), "\n"]
        known = sum(c[w] > 0 for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(words), known, total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + v + 1)) for w in words), rel=1e-9)
        assert 0 < r["bits_per_byte"] < 8


def test_beats_the_base_on_held_out_texts(spark):
    """Both sums are negative: the model's is nearer to zero by 5 % at least."""
    rows = registry.op2_context_tree(spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
