from __future__ import annotations

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilsift.llm import vector_blocks
from veilsift.llm.exact_topk import OP12_SQL, best_candidates, exact_top_k, op12_exact_topk
from veilsift.llm.hard_negatives import (
    LEAF, OP13_SQL, BoxTree, arranged, best_in_windows, mine_hard_negatives, op13_hard_negatives, tiles,
)
from veilsift.llm.vector_blocks import LEAST, MOST, Packed

DATA = "/root/testdata/sf0.01"


def whole(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def product(a, b, scale):
    floors = [[math.floor(scale * float(np.float32(x))) for x in v] for v in (a, b)]
    return sum(x * y for x, y in zip(*floors))


def plain_top_k(rows, asked, k, scale):
    rows = [r for r in rows if r[0] is not None and whole(r[1])]
    queries = {}
    for i, v in rows:
        if asked(i):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-product(v, w, scale), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def plain_negatives(rows, asked, positives, negatives):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and whole(r[1])]
    anchors = {}
    for i, v, label in rows:
        if asked(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-product(v, w, 256), i, same) for i, w, other in rows if i != a for same in [other == label]]
        for p, i, _ in sorted(x for x in scored if x[2])[:positives]:
            near = sorted(x for x in scored if not x[2] and -30 * p <= -100 * x[0] <= -90 * p)[:negatives]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(near)]
    return sorted(out)


def vectors(rng, n, dims=12, copies=True):
    made = [[rng.gauss(0, 1) / 4 for _ in range(dims)] for _ in range(n)]
    if copies:  # a third of all vectors are one, with equal scores
        made = [made[0] if rng.random() < 0.33 else v for v in made]
    return made


@pytest.mark.parametrize("seed", range(4))
def test_block_search_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    block = rng.integers(-300, 300, (700, 20))
    block[rng.random(700) < 0.3] = block[0]
    ids = rng.permutation(700)
    chunk = np.concatenate([rng.integers(-300, 300, (30, 20)), np.zeros((1, 20), int), block[:3]])
    own = np.concatenate([np.arange(900, 931), ids[:3]])
    asked = Packed(chunk, {"id": own, "low": np.full(len(chunk), LEAST)})
    at, found, score = best_candidates(Packed(block.T, {"id": ids}), asked, 10)
    for q in range(len(chunk)):
        want = sorted((-int(block[j] @ chunk[q]), int(ids[j])) for j in range(700) if ids[j] != own[q])[:10]
        assert [(-s, i) for i, s in zip(found[at == q].tolist(), score[at == q].tolist())] == want
    lowest = Packed(chunk, {"id": own, "low": np.full(len(chunk), 200_000)})
    at, found, score = best_candidates(Packed(block.T, {"id": ids}), lowest, 10)
    assert (score >= 200_000).all()
    big = Packed(block.T * (1 << 22), {"id": ids})  # beyond what floats hold exactly
    at, found, score = best_candidates(big, Packed(chunk * (1 << 10), asked.columns), 10)
    for q in range(len(chunk)):
        want = sorted((-int(block[j] @ chunk[q]) << 32, int(ids[j])) for j in range(700) if ids[j] != own[q])[:10]
        assert [(-s, i) for i, s in zip(found[at == q].tolist(), score[at == q].tolist())] == want
    with pytest.raises(OverflowError):
        best_candidates(Packed(block.T << 30, {"id": ids}), Packed(chunk << 30, asked.columns), 10)


def test_tiles_hold_each_row_once():
    rng = np.random.default_rng(3)
    for n, dims, kinds in ((1, 3, 1), (5000, 6, 3), (3000, 1, 900), (700, 0, 2), (129, 64, 1)):
        matrix, labels = rng.integers(-9, 9, (n, dims)), rng.integers(0, kinds, n)
        leaves = list(tiles(matrix, labels))
        assert sorted(np.concatenate(leaves).tolist()) == list(range(n))
        assert max(map(len, leaves)) <= LEAF * 2 and all(map(len, leaves))


@pytest.mark.parametrize("seed", range(3))
def test_tree_search_equals_plain_search(seed):
    rng = np.random.default_rng(seed)
    matrix = rng.integers(-60, 60, (3000, 8)) + 40 * rng.integers(-3, 3, (3000, 1))
    matrix[rng.random(3000) < 0.3] = matrix[5]
    labels, ids = rng.integers(0, 4, 3000), rng.permutation(3000)
    block = arranged(Packed(matrix, {"id": ids, "label": labels}))
    chunk = rng.integers(-60, 60, (12, 8))
    low, high = np.full(12, LEAST), np.full(12, MOST)
    low[3:8], high[3:8] = -2000, 3000
    low[8], high[8] = 5, 4
    columns = {"id": np.r_[ids[:6], -np.arange(1, 7)], "label": rng.integers(0, 4, 12), "low": low, "high": high}
    for same in (True, False):
        at, found, score = best_in_windows(block, Packed(chunk, columns), same, 7)
        for q in range(12):
            want = sorted(
                (-s, int(ids[j])) for j in range(3000) for s in [int(matrix[j] @ chunk[q])]
                if low[q] <= s <= high[q] and (labels[j] == columns["label"][q]) == same and ids[j] != columns["id"][q]
            )[:7]
            assert [(-s, i) for i, s in zip(found[at == q].tolist(), score[at == q].tolist())] == want


def test_tree_opens_few_leaves_where_boxes_are_tight():
    """Clustered rows, a narrow window: most boxes lie outside it or strictly below the k-th score."""
    rng = np.random.default_rng(1)
    matrix = (rng.integers(0, 40, (20_000, 1)) * 1000 + rng.integers(0, 30, (20_000, 4))).astype(np.int64)
    block = arranged(Packed(matrix, {"id": np.arange(20_000), "label": np.zeros(20_000, np.int64)}))
    tree = BoxTree(block, np.float64)
    from veilsift.llm.hard_negatives import AnchorSearch

    search = AnchorSearch(tree, np.ones(4), -1, 0, True)
    search.window(LEAST, 20_000, 10)
    assert len(search.leaves) < len(tree.starts) / 8


ODD = [
    (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 0.0]), (None, [0.5, 0.5]),
    (500, []), (600, [0.25]), (700, [0.1, 0.2, 0.3]), (700, [0.1, 0.2, 0.3]), (700, [0.0, 0.2, 0.3]), (800, [0.0, 0.0]),
]


def test_operators_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "SEED_ROWS", 40)
    monkeypatch.setattr(vector_blocks, "CHUNK", 3)
    rng = random.Random(5)
    rows = [*ODD, *((i, v) for i, v in zip(range(1000, 1400), vectors(rng, 400)))]
    rows = [(i, v, None if k % 50 == 9 else 0 if rng.random() < 0.4 else rng.randrange(1, 4)) for k, (i, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x"))
    df = df.withColumn("query_id", F.lit(1)).withColumn("id", F.lit("y")).repartition(5)
    asked = F.col("vec_id") % 50 == 0
    got = exact_top_k(df, asked, k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == plain_top_k(
        [r[:2] for r in rows], lambda i: i % 50 == 0, 7, 1024
    )
    mined = mine_hard_negatives(df, asked, positives=3, negatives=4)
    # a positive found twice gives its rows twice
    assert sorted(map(tuple, mined.collect())) == plain_negatives(rows, lambda i: i % 50 == 0, 3, 4)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert exact_top_k(df, F.col("vec_id") % 2 == 0).count() == 0
    assert mine_hard_negatives(df, F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(2, [0.5], 1), (4, None, 1)], df.schema)
    assert exact_top_k(one, F.col("vec_id") % 2 == 0).count() == 0
    assert mine_hard_negatives(one, F.col("vec_id") % 2 == 0).count() == 0


@pytest.mark.parametrize("query, sql", [(op12_exact_topk, OP12_SQL), (op13_hard_negatives, OP13_SQL)])
def test_queries_equal_their_sql(spark, query, sql):
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = query(spark, DATA)
    names = sorted(got.columns)
    want = con.execute(sql).fetchdf()[names]
    rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    assert len(rows) > 0 and rows == sorted(map(tuple, want.astype("int64").values.tolist()))
