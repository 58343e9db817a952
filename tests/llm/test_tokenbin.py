import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinprint.llm import registry, tokenbin

PATH = registry.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("n,spread", [(0, 5), (1, 5), (2000, 3), (5000, 200), (3000, 40000)])
def test_grammar_round_trip(n, spread):
    ids = np.random.default_rng(n).integers(0, spread, n)
    rules, lengths, sequence = tokenbin.compress(ids, 49408)
    table = tokenbin.expansions(rules, lengths, 49408)
    assert (tokenbin.expand(sequence, table) == ids).all()
    if n == 2000:
        assert len(rules) > 0 and len(sequence) < n / 2


def test_no_symbol_reaches_over_an_end():
    ids = np.array([5, 6, 2, 7, 8] * 50 + [9, 2, 2, 5, 6] * 40)
    rules, lengths, sequence = tokenbin.compress(ids, 49408)
    assert len(rules)
    table = tokenbin.expansions(rules, lengths, 49408)
    for symbol in range(49408, 49408 + len(rules)):
        assert 2 not in tokenbin.expand(np.array([symbol]), table)[:-1]


def test_runs_of_one_symbol_are_joined_in_few_rounds():
    # Each round made new rules for a run and shortened it by one symbol, so a small shard took hundreds of rounds.
    ids = np.array([*[5] * 3000, 2, 6, *[7] * 1001, 8, 2, *[5, 7] * 700, 2, *[9] * 9, 2])
    rules, lengths, sequence = tokenbin.compress(ids, 49408)
    assert (tokenbin.expand(sequence, tokenbin.expansions(rules, lengths, 49408)) == ids).all()
    assert len(rules) < 80 and len(sequence) < 120


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(3, 6), st.integers(1, 40)), max_size=30), st.integers(1, 6))
def test_runs_round_trip(runs, times):
    ids = np.array([x for _ in range(times) for a, n in runs for x in [a] * n] + [2])
    rules, lengths, sequence = tokenbin.compress(ids, 49408)
    assert (tokenbin.expand(sequence, tokenbin.expansions(rules, lengths, 49408)) == ids).all()


def test_expansions_of_rules_on_rules():
    rules = np.array([[1, 2], [10, 3], [11, 10], [4, 5], [13, 12]], "<u2")
    flat, first, size = tokenbin.expansions(rules, np.array([2, 3, 5, 2, 7], "<u4"), 10)
    assert [flat[a : a + n].tolist() for a, n in zip(first[10:], size[10:])] == [[1, 2], [1, 2, 3], [1, 2, 3, 1, 2], [4, 5], [4, 5, 1, 2, 3, 1, 2]]
    with pytest.raises(ValueError):
        tokenbin.expansions(np.array([[1, 10]], "<u2"), np.array([2], "<u4"), 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([5, 6, 7]), max_size=6), min_size=1, max_size=12), st.integers(8, 40))
def test_documents_of_repeated_starts_and_ends_decode_alone(docs, times):
    docs = [np.array([*d, 2], "<u2") for d in docs * times]
    row = tokenbin._shard(0, 0, 49408, list(range(len(docs))), [d.tobytes() for d in docs])
    for k, d in enumerate(docs):
        assert tokenbin.decode(row, k).tolist() == d.tolist()


def brute(rows):
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


TEXTS = ["", " \n ", "The the THE. thing, it's 'S can't", "a<|endoftext|>b <|ENDOFTEXT|> c", "É́ É ́x \x1cq \x85r\xa0s  t", "ΑΣ ΣΑΣ. İI ß", "日本語 テスト 12.5 １２", "x" * 3000, "of the " * 4000, "!!! ... a.b, c,, d.", "ﬁ ﬂ ½ K 가.", "🙂🙂 ok.🙂",
         " lead, trail. ", "<|x a's 'S <a|b|> \tc", "abc$$$ ab.&&& x'' x's. q'.t it's't A1, 1.2$ é%% -a- a--b",
         "ÀÉÎ treêau Ÿ ÿ ß ẞ Ñandú, crème. œuvre ªº µ × ÷ naïve don't l'été Ærø ŠŽ İstanbul ſ"]


def test_words_encode_as_whole_texts():
    encoder, tok = tokenbin.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        for t, raw in zip(TEXTS, encoder.batch(pa.array(TEXTS))):
            assert np.frombuffer(raw, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_edges_and_small_shards(spark, monkeypatch):
    rows = [(None, "no id"), *((k, t) for k, t in enumerate(TEXTS)), (len(TEXTS), None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, part int").repartition(3)
    for size in (1 << 20, 50):
        monkeypatch.setattr(tokenbin, "SHARD_IDS", size)
        got = tokenbin.read_documents(tokenbin.store(df, PATH)).orderBy("start").collect()
        assert [tuple(r) for r in got] == brute(rows)
    assert tokenbin.read_documents(tokenbin.store(df.filter("false"), PATH)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same words"), (1, "same words"), (0, "first")], "doc_id long, text string")
    got = tokenbin.read_documents(tokenbin.store(df, PATH)).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute([(0, "first"), (1, "same words"), (1, "same words")])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_real_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = registry.op7_token_shards(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute([(r["doc_id"], r["text"]) for r in docs])
