"""Operator 6 against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilsift.llm import near_dup as N


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10 ** 6)}"
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 150]))]
        chain = base
        for k in range(rng.choice([1, 2, 9])):
            texts.append(" ".join(chain))
            chain = edited(rng, chain if g % 2 else base, max(1, len(base) // 60))
    chain = [f"c{k}" for k in range(120)]
    for _ in range(30):  # its ends share little
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 2)
    base = [f"b{k}" for k in range(100)]  # copies edited on their own, many in several places
    texts += [" ".join(edited(rng, base, rng.randrange(1, 9))) for _ in range(80)]
    texts += [texts[3]] * 7 + [texts[3].upper()] + ["one two", "one two", "One  Two", "one two three"]
    texts += [None, None, "", "  "] + ["alone " + " ".join(f"q{rng.randrange(999)}" for _ in range(30)) for _ in range(5)]
    return texts


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(texts, similarity=0.8):
    root = list(range(len(texts)))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    sets = [shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [top(k) for k in range(len(texts))]


def test_classes(spark):
    texts = corpus()
    df = spark.createDataFrame(
        [(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, node string"
    ).repartition(5)
    want = brute(texts)
    got = {r.doc_id: r for r in N.near_duplicate_classes(df).collect()}
    assert [got[k].class_id for k in range(len(texts))] == want
    assert all(got[k].class_size == want.count(want[k]) for k in got)
    assert len(set(want)) < len(texts) - 20
    kept = N.drop_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want)) and set(kept[0].asDict()) == {"doc_id", "text", "node"}


def test_repeated_rows_null_ids_and_no_rows(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(None, long), (5, long), (5, long), (5, "other text of six words here"), (None, None), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in N.near_duplicate_classes(df).collect()), key=str)
    want = [(5, 5, 3), (5, 5, 3), (None, 5, 3), (5, 5, 1), (None, None, 1), (7, 7, 2), (7, 7, 2)]
    assert got == sorted(want, key=str)
    kept = sorted(((r.doc_id, r.text) for r in N.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(5, long), (5, rows[3][1]), (None, None), (7, None)], key=str)
    assert N.near_duplicate_classes(df.limit(0)).count() == 0 and N.drop_near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = rng.integers(0, 5, 60).astype(float), rng.integers(0, 5, 60) * 0.37
    rows = np.repeat([0, 1], 60)
    weights = np.concatenate([a, b])
    some = weights > 0
    k = 4000
    made = N.dart_signatures(rows[some], np.tile(elements, 2)[some], weights[some], 2, k)
    real = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((made[0] == made[1]).mean() - real) < 5 * np.sqrt(real * (1 - real) / k)


def test_equal_sets_and_tiny_texts_have_equal_signatures():
    rows, found, counts = N.text_shingles(pa.array(["a b c d e f a b c d e f", "a b c d e f  a b c d e f", "x", ""]))
    made = N.dart_signatures(rows, found, np.ones(len(rows)), 4, 50)
    assert (made[0] == made[1]).all() and made[2].any() and not made[3].any()
    assert counts.sum() == 8 + 8 + 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 103), (103, 101), (101, 100), (200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in N.smallest_neighbours(df, N.Scratch(spark)).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100, 103: 100}
    assert N.smallest_neighbours(df.where(F.lit(False)), N.Scratch(spark)).count() == 0
