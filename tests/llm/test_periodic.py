from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from veilsift.llm.arrowtext import distinct_parts
from veilsift.llm.periodic import RangeSuccessor, find_periodic_runs, find_runs, op11_periodic_runs


def plain_runs(words):
    """All runs by their definition: for each period, the stretches of equal words that far apart."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # a smaller period of the same stretch came first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def runs_of(texts):
    words = distinct_parts(pc.ascii_split_whitespace(pa.array(texts, pa.string())))
    runs = find_runs(words)
    out = [[] for _ in texts]
    for r, *run in zip(*(x.tolist() for x in (runs.row, runs.start, runs.length, runs.period))):
        out[r].append(tuple(run))
    return out


def smallest_only(runs):
    """A stretch with period q that also has a smaller period is a run of the smaller one."""
    return [
        (s, n, q) for s, n, q in runs
        if not any(s2 <= s and s2 + n2 >= s + n and q2 < q for s2, n2, q2 in runs)
    ]


def expected(text):
    return smallest_only(plain_runs(re.findall(r"[^\x20\x09-\x0D]+", text or "")))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=4))
def test_equal_to_the_definition(texts):
    joined = [" ".join(t) for t in texts]
    assert runs_of(joined) == [expected(t) for t in joined]


@settings(max_examples=150, deadline=None)
@given(st.lists(
    st.tuples(st.lists(st.sampled_from("abcde"), min_size=1, max_size=12), st.integers(1, 7), st.integers(0, 11)),
    max_size=6,
))
def test_repeated_words_with_incomplete_ends(parts):
    words = []
    for unit, times, rest in parts:
        words += unit * times + unit[:rest]
    text = " ".join(words)
    assert runs_of([text, text]) == [expected(text)] * 2


def test_range_successor():
    rng = random.Random(4)
    import numpy as np

    values = np.array(rng.sample(range(300), 300))
    finder = RangeSuccessor(values)
    for _ in range(200):
        low, high = sorted(rng.choices(range(301), k=2))
        x = rng.randrange(300)
        want = min((v for v in values[low:high] if v >= x), default=-1)
        assert finder.successor(*(np.array([v]) for v in (low, high, x)))[0] == want


def test_very_long_texts():
    rng = random.Random(1)
    unit = [str(rng.randrange(10**6)) for _ in range(70_000)]
    texts = ["a " * 300_000, " ".join(unit * 4 + unit[:5]), " ".join(str(rng.randrange(50)) for _ in range(400_000))]
    began = time.time()
    one, two, three = runs_of(texts)
    assert one == [(0, 300_000, 1)] and two == [(0, 280_005, 70_000)]
    assert all(n >= max(6, 4 * q) for _, n, q in three)
    assert time.time() - began < 60


def test_operator_edges(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "z" + " a\tb\n" * 4 + " c", None),
        (4, "z" + " a\tb\n" * 4 + " c", None), (5, "a a a a a a", "x"), (6, "a a a a a", "x"), (7, "é é é é é é", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r.doc_id): r for r in find_periodic_runs(df).collect()}
    assert got[1].runs == got[2].runs == got[3].runs == [] and got[1].collapsed == "" and got[1].n_words == 0
    assert [tuple(r) for r in got[4].runs] == [(1, 8, 2)] and got[4].collapsed == "z a b c"
    assert [tuple(r) for r in got[5].runs] == [(0, 6, 1)] and got[5].collapsed == "a"
    assert got[6].runs == [] and got[6].collapsed == "a a a a a"
    assert got[7].collapsed == "é"
    assert find_periodic_runs(df).count() == len(rows)
    empty = find_periodic_runs(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = smallest_only(plain_runs(words))
    drop = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    best = min(((-n_, s, q) for s, n_, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90)))) for k in range(400)]
    rows += [(k, " ".join(f"w{rng.randrange(1000)}" for _ in range(rng.randrange(400)))) for k in range(400, 700)]
    rows += [(9001, None), (9002, ""), (9003, "\x1ca\x1c a"), (5, "again a a a a a a"), (5, "again a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(brute(*r)) for r in rows)
