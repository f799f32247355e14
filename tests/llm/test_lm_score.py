"""Operator 2 against a plain model of the same definition."""

import random
from collections import Counter
from math import log2

import pytest
from pyspark.sql import functions as F

from veilsift.llm import lm_score as M

TEXTS = [
    (0, "a b a b c", True), (1, "a b", True), (2, "x y z a", False), (3, "x y x y", False), (4, None, True),
    (5, "", False), (6, "A B", None), (7, "rare words only here", False), (8, "a b a b c", False),
]


def plain(texts, least_words, least_pairs):
    words = {k: (t or "").lower().split() for k, t, _ in texts}
    counts = Counter(w for ws in words.values() for w in ws)
    known = {w for w, n in counts.items() if n >= least_words}
    seen = lambda w: w if w in known else None
    pairs = [Counter(), Counter()]
    for k, _, target in texts:
        before = "<s>"
        for w in map(seen, words[k]):
            pairs[1][before, w] += 1
            pairs[0][before, w] += bool(target)
            before = w
    total = [sum(p.values()) for p in pairs]
    kept = {p for p in pairs[1] if any(pairs[m][p] >= max(least_pairs * total[m], 1) for m in (0, 1))}

    def loss(m, h, w):
        after = sum(n for (_, x), n in pairs[m].items() if x == w)
        share = (after + M.ADDED) / (total[m] + M.ADDED * (len(known) + 1))
        heads = max(sum(n for (x, _), n in pairs[m].items() if x == h), 1)
        own = lambda p: max(pairs[m][p] - M.DISCOUNT, 0) / heads if p in kept else 0.0
        rest = max(1 - sum(own(p) for p in kept if p[0] == h), 1e-12)
        return -log2(own((h, w)) + rest * share)

    out = {}
    for k, ws in words.items():
        path = list(zip(["<s>", *map(seen, ws)], map(seen, ws)))
        out[k] = [(loss(0, h, w), loss(1, h, w)) for h, w in path]
    return out


@pytest.mark.parametrize("word_share, pair_share", [(1e-9, 1e-9), (0.1, 0.12)])
def test_losses(spark, word_share, pair_share):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, target boolean")
    total = sum(len((t or "").split()) for _, t, _ in TEXTS)
    want = plain(TEXTS, word_share * total, pair_share)
    models = M.fit_models(df.withColumn("target", F.coalesce("target", F.lit(False))), word_share, pair_share)
    rows = M.score_texts(df.withColumn("score", F.lit("clash")), models, token_differences=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        each = want[r.doc_id]
        assert r.n_words == len(each)
        assert r.token_differences == pytest.approx([a - b for a, b in each])
        if each:
            assert r.score == pytest.approx(sum(a - b for a, b in each) / len(each))
            assert r.target_loss == pytest.approx(sum(a for a, _ in each) / len(each))
        else:
            assert r.score is None and r.target_loss is None


def test_no_rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, target boolean")
    models = M.fit_models(df.limit(0))
    assert M.score_texts(df.limit(0), models).count() == 0 and M.score_texts(df, models).count() == len(TEXTS)


def test_query_prefers_the_target(spark, tmp_path):
    good = "the plain good words of a text stand here in order"
    bad = "buy cheap now click win cash free prize offer today"
    docs = [(k, good if k % 2 else bad, "x") for k in range(40)] + [(50, good, "x"), (51, bad, "x"), (None, good, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, quality string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, k % 2, 0) for k in range(30)] + [(1, 1, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r.score for r in M.op2_lm_difference(spark, str(tmp_path)).collect()}
    assert len(rows) == 43 and rows[50] < rows[51]


def test_rare_words_stay_known_in_a_large_corpus(spark):
    # 400,000 words in all: by a share of the corpus, a pair of words seen twice would be unknown
    common = " ".join(["common filler"] * 100)
    texts = [(k, common, k % 2 == 0) for k in range(2000)]
    texts += [(5000, "scarce gem", True), (5001, "scarce gem", True), (5002, "odd stone", False), (5003, "odd stone", False)]
    df = spark.createDataFrame(texts, "doc_id long, text string, target boolean")
    models = M.fit_models(df)
    probe = df.where("doc_id >= 5000")
    want = plain(texts, 1, 1e-12)
    for options in ({"hot_share": 2.0}, {"hot_share": 1e-5}, {"fitted": True}, {"fitted": True, "hot_share": 2.0}):
        rows = {r.doc_id: r for r in M.score_texts(probe, models, token_differences=True, **options).collect()}
        assert len(rows) == 4 and rows[5000].score < rows[5002].score
        for k, r in rows.items():
            assert r.n_words == 2 and r.token_differences == pytest.approx([a - b for a, b in want[k]])
            assert r.target_loss == pytest.approx(sum(a for a, _ in want[k]) / 2)
            assert r.background_loss == pytest.approx(sum(b for _, b in want[k]) / 2)


def fitted_rows(spark, texts, **options):
    df = spark.createDataFrame(texts, "doc_id long, text string, target boolean")
    rows = M.score_texts(df, M.fit_models(df), token_differences=True, fitted=True, **options).collect()
    assert len(rows) == len(texts)
    return rows


@pytest.mark.parametrize("slice_bytes", [16 << 20, 40])
def test_fitted_texts_in_one_and_many_slices(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(M, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(M, "TABLE_BYTES", 100)
    texts = [(k, t, bool(target)) for k, t, target in TEXTS] + [(9, "a b", True), (9, "x É x", False), (None, None, False)]
    want = plain([(j, t, target) for j, (_, t, target) in enumerate(texts)], 1, 1e-12)
    by_text = {t: want[j] for j, (_, t, _) in enumerate(texts)}
    for r in fitted_rows(spark, [(k, t, target) for k, t, target in texts]):
        each = next(v for t, v in by_text.items() if (t or "").split() == (r.text or "").split())
        assert r.n_words == len(each) and r.token_differences == pytest.approx([a - b for a, b in each])
        if each:
            assert r.target_loss == pytest.approx(sum(a for a, _ in each) / len(each))
            assert r.background_loss == pytest.approx(sum(b for _, b in each) / len(each))
            assert r.score == pytest.approx(sum(a - b for a, b in each) / len(each))
        else:
            assert r.score is None and r.target_loss is None and r.background_loss is None


def test_fitted_equals_joined_and_targets_by_id(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(rng.choices(vocabulary, range(1, 61), k=rng.randrange(40))), k % 3 == 0) for k in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string, target boolean").repartition(5)
    by_id = M.fit_models(df.drop("target"), targets=df.where("target").select("doc_id").union(df.limit(1).select(F.lit(None))))
    found = [
        {r.doc_id: (r.n_words, r.target_loss, r.background_loss, r.score) for r in M.score_texts(df, m, fitted=f).collect()}
        for m, f in ((M.fit_models(df), False), (M.fit_models(df), True), (by_id, True), (by_id, False))
    ]
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[k] == pytest.approx(v) for k, v in found[0].items())


def test_fitted_moves_no_pair_as_a_row_and_no_slice(spark):
    text = " ".join(f"a{k} b{k % 7}" for k in range(3000))
    df = spark.createDataFrame([(k, text, k == 0) for k in range(8)], "doc_id long, text string, target boolean")
    models = M.fit_models(df)
    slices, marks = M.coded_texts(models)
    asked = slices.groupBy("slice").cogroup(marks.groupBy("slice")).applyInArrow(
        lambda row, answers: (lambda s: s.requests(s.pairs, s.pair_counts(), 3))(M.Slice(row, answers)), M.REQUESTS
    )
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slice") == 1  # the answers alone
    assert asked.count() <= 8 * slices.count()
    assert "tables" not in models.__dict__  # no pair table was made


def test_no_fitted_texts_and_no_targets(spark):
    assert fitted_rows(spark, [(1, "a b", False), (2, None, False)])[0] is not None
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, target boolean").limit(0)
    assert M.score_texts(df, M.fit_models(df), fitted=True).count() == 0
