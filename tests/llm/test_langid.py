import itertools

import numpy as np
import pytest

from kinprint.llm import langid, registry


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for n, k in [(1, 3), (2, 2), (5, 3), (6, 2)]:
        for penalty in (0.1, 1.0, 3.0):
            s = rng.normal(size=(n, k))
            value = lambda p: sum(s[t, p[t]] for t in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
            best = max(value(p) for p in itertools.product(range(k), repeat=n))
            assert value(langid.viterbi(s, penalty)) == pytest.approx(best)


def test_held_out_accuracy(spark):
    got = registry.op10_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id"
    ).filter("held_out and lang is not null").collect()
    assert len(got) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_spans_scripts_and_edges(spark):
    train = [("en", "the cat sat on the mat with the hat and then that was this " * 5)] * 3
    train += [("de", "der hund und die katze sind nicht auf dem dach mit dem ball " * 5)] * 3
    train += [("ru", "кошка сидит на окне и смотрит на улицу где идет дождь " * 5)] * 3 + [(None, "ignored"), ("en", None)]
    model = langid.learn(spark.createDataFrame(train, "lang string, text string"))
    assert model.languages == ["de", "en", "ru"]
    mixed = "the cat sat on the mat " * 4 + "und die katze ist nicht auf dem dach " * 4 + "кошка на окне"
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 !? \n"), (5, "кошка"), (6, "日本語"), (6, "日本語"), (None, "the mat " * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 0.0) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = langid.identify(df, model).collect()
    one = next(r for r in got if r["doc_id"] == 1)
    assert [s["lang"] for s in one["spans"]] == ["en", "de", "ru"] and one["spans"][0]["begin"] == 0
    assert all(r["lang"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 4))
    assert [r["lang"] for r in got if r["doc_id"] == 5] == ["ru"]
    assert len({r["lang"] for r in got if r["doc_id"] == 6}) == 1
    assert [(r["lang"], r["score"]) for r in got if r["doc_id"] is None] == [("en", 1.0)]
    nothing = langid.learn(df.filter("false"))
    assert {r["lang"] for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.filter("false"), model).count() == 0
