import hashlib
import random

import numpy as np
import pytest

from kinprint.llm import registry, suffixes


def brute(rows, length=50):
    texts = [(t or "").encode() for _, t in rows]
    ids = [suffixes.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for i, t in zip(ids, texts):
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if i < least.get(s, 1 << 64):
                least[s] = i
    out = []
    for (raw, _), i, t in zip(rows, ids, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((raw, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return [
        (r["id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())
        for r in suffixes.remove_repeats(df).collect()
    ]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("seed,piece", [(0, 1 << 20), (1, 200), (2, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, seed, piece):
    rnd = random.Random(seed)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "GROUP", 1 << 16 if seed else 7)
    letters = "ab \né" if seed == 2 else "abcdefgh \né日\0"
    passages = ["".join(rnd.choice(letters) for _ in range(rnd.randint(30, 160))) for _ in range(12)]
    rows = []
    for k in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(rnd.randint(0, 6))]
        rows.append((rnd.randint(0, 50), "".join(parts)))
    rows += [(None, passages[0] * 2), (None, passages[0] * 2), (7, None), (8, ""), (9, "x" * 400), (10, "x" * 60 + "y"), (11, "ab" * 300), (12, "x" * 49), (900, passages[1] * 40), (5, rows[0][1]), (5, rows[0][1])]
    rows += [(1000 + k, "pre" + passages[2] + passages[3] + "post") for k in range(30)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, id int, kept string")
    assert sorted(result(df), key=key) == sorted(brute(rows), key=key)


def test_real_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in registry.op6_suffix_dedup(spark, sf).collect()]
    want = brute(rows)
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 0


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_refinement_numbers_equal_strings_equally():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (200, suffixes.WIDTH)).astype(np.uint8)
    rows[100:] = rows[:100]
    rows[100:, :10] = 3
    number = suffixes.refined(rows)
    name = {}
    for r in range(200):
        for p in range(suffixes.LENGTH - suffixes.Q + 1):
            s = rows[r, p : p + suffixes.LENGTH].tobytes()
            assert name.setdefault(s, number[r, p]) == number[r, p]
    assert len(set(name.values())) == len(name)
