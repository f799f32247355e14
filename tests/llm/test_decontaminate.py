"""Operator 10 against a plain greedy tiling."""

import random

import numpy as np
from pyspark.sql import functions as F

from veilsift.llm import decontaminate as D


def plain_tiles(text, item, least):
    free_t, free_i, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for i in range(len(item)):
                n = 0
                while (t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n]
                       and free_t[t + n] and free_i[i + n]):
                    n += 1
                if n > best[0]:
                    best = (n, t, i)
        n, t, i = best
        if n < least:
            return out
        out.append((t, i, n))
        for k in range(n):
            free_t[t + k] = free_i[i + k] = False


def test_tiles():
    rng = random.Random(1)
    for _ in range(150):
        k, least = rng.choice([2, 3, 8]), rng.choice([1, 2, 3, 5])
        text = np.array([rng.randrange(1, k + 1) for _ in range(rng.randrange(40))], np.uint64)
        item = np.array([rng.randrange(1, k + 1) for _ in range(rng.randrange(25))], np.uint64)
        assert D.greedy_tiles(text, item, least) == plain_tiles(text.tolist(), item.tolist(), least)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then sleeps until noon today"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, "too short item"), (4, None), (5, ""),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, "same same same same same same same same"),
]
WORDS = ITEMS[1][1].split()
TEXTS = [
    (0, "Intro. the QUICK brown fox, jumps over the lazy dog: and then sleeps until noon today! Outro"),
    (1, "x " + " ".join(WORDS[5:]) + " in between " + " ".join(WORDS[:5])),  # reordered
    (2, " ".join(WORDS[:5]) + " and nothing more"), (3, " ".join(WORDS[:4]) + " cut " + " ".join(WORDS[6:])),
    (4, None), (5, ""), (6, "too short item"), (7, "same " * 50), (8, "clean text of other words that match nothing"),
    (9, "filler words " * 4000 + " ".join(WORDS)),
]


def frame(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("leaks", F.lit("clash"))


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_leaks(spark):
    want = {(0, 1): 1.0, (1, 2): 1.0, (2, 2): 0.5, (7, 6): 1.0, (9, 2): 1.0}
    for block_bytes in (1 << 20, 60):  # one block, and several
        rows = D.leaked_items(frame(spark), benchmark(spark), block_bytes=block_bytes).collect()
        assert {(r.doc_id, r.item_id): r.coverage for r in rows} == want
        assert len(rows) == len(want)
    tiles = {(r.doc_id, r.item_id): r.tiles for r in rows}
    assert [tuple(t) for t in tiles[1, 2]] == [(1, 5, 5), (8, 0, 5)]
    assert {(r.doc_id, r.item_id) for r in D.leaked_items(frame(spark), benchmark(spark), coverage=0.6).collect()} \
        == {k for k, v in want.items() if v >= 0.6}


def test_all_rows_stay_with_their_columns(spark):
    rows = D.with_leaks(frame(spark), benchmark(spark)).collect()
    assert len(rows) == len(TEXTS) and {r.doc_id for r in rows if not r.leaks} == {3, 4, 5, 6, 8}


def test_no_rows_no_items(spark):
    assert D.leaked_items(frame(spark).limit(0), benchmark(spark)).count() == 0
    assert D.leaked_items(frame(spark), benchmark(spark).limit(0)).count() == 0
