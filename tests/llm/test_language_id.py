"""Operator 3: forward-backward against enumeration, and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilsift.llm import crf
from veilsift.llm import language_id as I

SYLLABLES = {"aa": "ta ko mi ra shi no ka".split(), "bb": "str ung ach sch ein pf".split(), "cc": "eau oux ille ai tion".split()}


def text_in(rng, lang, n=60):
    word = lambda: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))
    return " ".join(word() for _ in range(n)) + "."


def test_chances_by_enumeration():
    rng = np.random.default_rng(0)
    for sizes in ([1, 2, 5], [4, 0, 3]):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        scores, move = rng.normal(size=(offsets[-1], 3)) * 2, rng.normal(size=(3, 3))
        got = crf.label_chances(scores, offsets, move)
        for a, b in zip(offsets[:-1], offsets[1:]):
            want = np.zeros((b - a, 3))
            for y in itertools.product(range(3), repeat=int(b - a)):
                total = sum(scores[a + t, y[t]] for t in range(b - a)) + sum(move[p, q] for p, q in zip(y, y[1:]))
                for t in range(b - a):
                    want[t, y[t]] += np.exp(total)
            if b > a:
                assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    offsets = np.array([0, 70, 71, 200])
    scores, move = rng.normal(size=(200, 4)), rng.normal(size=(4, 4))
    blocked = crf.label_chances(scores, offsets, move)
    monkeypatch.setattr(crf, "CHAIN_BLOCK", 1000)
    assert np.allclose(blocked, crf.label_chances(scores, offsets, move))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(k, text_in(rng, lang), lang) for k, lang in enumerate(list(SYLLABLES) * 80)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", None), (1003, rows[0][1], None), (1004, rows[0][1], "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


def test_held_out_accuracy_and_edges(spark, docs):
    model = I.fit_on_documents(docs)
    assert model.labels == sorted(SYLLABLES)
    rows = I.identify_languages(docs.withColumn("score", F.lit("clash")), model).withColumn("held_out", I.held_out()).collect()
    by_id = {r.doc_id: r for r in rows}
    told = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert len(told) > 20 and np.mean([r.lang == r.lang_pred for r in told]) > 0.98
    assert [by_id[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[1003].lang_pred == by_id[1004].lang_pred and all(0 <= r.score <= 1 for r in rows)


def test_code_switched_words(spark, docs):
    rng = random.Random(9)
    text = " ".join([text_in(rng, "aa", 30), text_in(rng, "cc", 30)])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    runs = I.identify_languages(df, I.fit_on_documents(docs), runs=True).first().lang_runs
    assert sum(r.words for r in runs) == 60 and runs[0].lang == "aa" and runs[-1].lang == "cc"
    assert abs(sum(r.words for r in runs if r.lang == "aa") - 30) <= 3


def test_evenly_mixed_texts_are_clear(spark, docs):
    """No language leads, but every word is clear; a null text is neither."""
    rng = random.Random(4)
    mixed = " ".join(text_in(rng, lang, 40) for lang in ("aa", "bb", "cc"))
    df = spark.createDataFrame([(1, mixed), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in I.identify_languages(df, I.fit_on_documents(docs), clarity_col="c").collect()}
    assert got[1].score < 0.5 and got[1].c > 0.8 and (got[2].score, got[2].c) == (0, 0)


def test_nothing_to_learn_from(spark, docs):
    assert I.fit_on_documents(docs.limit(0)) is None
    rows = I.identify_languages(docs.limit(3), None, runs=True).collect()
    assert [(r.lang_pred, r.score, r.lang_runs) for r in rows] == [("und", 0.0, [])] * 3
    assert I.identify_languages(docs.limit(0), I.fit_on_documents(docs)).count() == 0


def test_query_learns_from_the_right_rows(spark, docs, tmp_path):
    # a label that only held-out rows have is never learned
    odd = docs.withColumn("lang", F.when(I.held_out(), "zz").otherwise(F.col("lang")))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = I.op3_language_id(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert {r.lang_pred for r in got.collect()} <= {*SYLLABLES, "und"}


def test_sample_counts_copies_once(spark):
    rng = random.Random(5)
    rows = [(text_in(rng, "aa"), "aa") for _ in range(40)] + [(text_in(rng, "bb"), "bb") for _ in range(5)] * 400
    got = I.fit_sample(spark.createDataFrame(rows, "text string, lang string"), 5, 6000).collect()
    assert [sum(r.lang == lang for r in got) for lang in ("aa", "bb")] == [5, 5]
    assert len({r.text for r in got}) == 10 and {(r.text, r.lang) for r in got} <= set(rows)


def test_sample_takes_stretches_of_long_texts_where_short_ones_do_not_fill_it(spark):
    rng = random.Random(6)
    short = [(text_in(rng, "aa"), "aa") for _ in range(8)] + [(text_in(rng, "bb"), "bb") for _ in range(2)]
    long = [(text_in(rng, lang, 200), lang) for lang in ("aa", "bb", "cc") for _ in range(8)]
    df = spark.createDataFrame(short + long, "text string, lang string")
    got = I.fit_sample(df, 5, 500).collect()
    assert {lang: sum(r.lang == lang for r in got) for lang in SYLLABLES} == {"aa": 5, "bb": 5, "cc": 5}
    whole = {t for t, _ in short}
    assert all(r.text in whole for r in got if r.lang == "aa") and {t for t, k in short if k == "bb"} <= {r.text for r in got}
    for r in got:
        assert r.text in whole or any(t.startswith(r.text + " ") and len(r.text) <= 500 for t, _ in long)
    assert I.fit_language_model(df, 5, 500).labels == sorted(SYLLABLES)
