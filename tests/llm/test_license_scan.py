"""Operator 7: planted templates, whole and changed, and the alignment against a plain one."""

import random

import numpy as np
import pyarrow as pa

from veilsift.llm import license_scan as L
from veilsift.llm.license_texts import TEMPLATES


def test_every_template_is_found_where_it_stands(spark):
    rows = [(k, f"Some words before.\n{TEMPLATES[n]} And after.", n) for k, n in enumerate(sorted(TEMPLATES))]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    for r in L.scan_licenses(df).collect():
        name = rows[r.doc_id][2]
        hit = next(x for x in r.licenses if x.template == name)
        assert hit.coverage == 1.0
        shown = r.text[hit.start:hit.end]
        assert " ".join(shown.split()).strip(".") in " ".join(TEMPLATES[name].split())


def test_changed_partial_and_no_copies(spark):
    words = TEMPLATES["mit"].split()
    rng = random.Random(2)
    changed = list(words)
    for k in rng.sample(range(len(words)), 12):
        changed[k] = "other"
    del changed[40:44]
    texts = [" ".join(changed), " ".join(words[:50]), " ".join(rng.sample(words, len(words))), None, "", "All rights",
             "intro " * 500 + TEMPLATES["mit-notice"] + " x " * 300 + TEMPLATES["mit-notice"].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.template, x.coverage) for x in r.licenses] for r in L.scan_licenses(df).collect()}
    assert [t for t, c in got[0]] == ["mit"] and 0.8 <= got[0][0][1] < 1
    assert all(got[k] == [] for k in (1, 2, 3, 4, 5)) and got[6] == [("mit-notice", 1.0)] * 2
    assert L.scan_licenses(df.limit(0)).count() == 0


def plain_best(template, text):
    score = np.zeros((len(template) + 1, len(text) + 1), int)
    for i in range(len(template)):
        for j in range(len(text)):
            score[i + 1, j + 1] = max(
                0, score[i, j] + (1 if template[i] == text[j] else L.MISS), score[i, j + 1] + L.GAP, score[i + 1, j] + L.GAP
            )
    return score.max()


def test_alignment_is_the_plain_one_inside_the_band():
    rng = np.random.default_rng(3)
    for _ in range(60):
        template = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64)
        matched, first, last = L.banded_alignment(template, text, 0, 40)
        assert matched >= plain_best(template.tolist(), text.tolist())  # matches less the losses between
        assert (matched == 0) == (first == -1) and first <= last < len(text)


def test_winnowing_keeps_one_print_a_window():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 50, 200).astype(np.uint64)
    at = set(L.winnowed(hashes, 4).tolist())
    assert all(at & set(range(k, k + 4)) for k in range(197)) and len(at) < 160
    assert L.winnowed(hashes[:2], 4).tolist() and not len(L.winnowed(hashes[:0], 4))


def test_query_rows(spark, tmp_path):
    rows = [(1, TEMPLATES["gpl-3.0-notice"]), (2, None), (3, "nothing here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op7_license_scan(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.template, r.coverage) for r in got] == [(1, "gpl-3.0-notice", 1.0)]
    assert L.licenses_in(L.PrintIndex(TEMPLATES), pa.array([""]), 0.8) == [[]]


def test_short_notices_with_changed_words():
    index = L.PrintIndex(TEMPLATES)
    for name in ("mit-notice", "cc-by-nc-notice", "apache-2.0-notice"):
        words = TEMPLATES[name].split()
        texts = [" ".join(["before", "it", *words[:k], "changed", *words[k + 1:], "behind"]) for k in range(len(words))]
        for found in L.licenses_in(index, pa.array(texts), L.COVERAGE):
            assert name in [x["template"] for x in found]
    texts = ["Released under an MIT License.", "Licensed under the Apache Licence, Version 2.0."]
    found = L.licenses_in(index, pa.array(texts), L.COVERAGE)
    assert [[(x["template"], x["matched_words"]) for x in f] for f in found] == [[("mit-notice", 4)], [("apache-2.0-notice", 6)]]


def found_in(texts, templates=TEMPLATES):
    return L.licenses_in(L.PrintIndex(templates), pa.array(texts), L.COVERAGE)


def test_copies_back_to_back():
    bsd = next(n for n in sorted(TEMPLATES) if "bsd" in n)
    for name, times in ((bsd, 5), ("mit-notice", 40), ("mit", 7)):
        copy = TEMPLATES[name]
        got = [x for x in found_in([" ".join([copy] * times)])[0] if x["template"] == name]
        assert len(got) == times and all(x["coverage"] == 1 for x in got)
        assert [x["start"] for x in got] == sorted({x["start"] for x in got})
    got = found_in(["All rights reserved. " * 3, "gnu", "x gnu gnu y"], {"rights": "All rights reserved", "one": "GNU"})
    assert [len(g) for g in got] == [3, 1, 2]


def test_all_copies_against_every_place():
    """Random templates in random texts: whole, changed, nested and back to back, against all places."""
    rng = random.Random(11)
    for _ in range(60):
        letters = [f"w{i}" for i in range(rng.choice((8, 40)))]
        templates = {f"t{n}": " ".join(rng.choices(letters, k=rng.choice((2, 3, 5, 9, 20, 45)))) for n in range(3)}
        text, want = [], []
        for _ in range(rng.randrange(1, 9)):
            if rng.random() < 0.5:
                text += [f"other{i}" for i in range(rng.randrange(12))]
            name = rng.choice(sorted(templates))
            words = templates[name].split()
            places = rng.sample(range(len(words)), rng.randint(0, L.places_changed(len(words), L.COVERAGE)))
            want.append((name, len(text), len(words), len(words) - len(places)))
            text += ["changed" if i in places else w for i, w in enumerate(words)]
        got = {}
        for x in found_in([" ".join(text)], templates)[0]:
            first = len(" ".join(text)[:x["start"]].split())
            last = len(" ".join(text)[:x["end"]].split())
            got.setdefault(x["template"], []).append((first, last, x["matched_words"]))
            assert x["matched_words"] >= L.COVERAGE * len(templates[x["template"]].split())
        for name in templates:
            spans = sorted(got.get(name, []))
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # no word counts twice
        for name, start, length, _ in want:
            assert any(a < start + length and b > start for a, b, _ in got.get(name, [])), (templates, text, name)
        plain = sum(
            templates[name].split() == text[i:i + len(templates[name].split())]
            for name in {w[0] for w in want} for i in range(len(text))
        )
        assert sum(map(len, got.values())) >= min(plain, len(want))


def test_ten_megabytes():
    import time

    text = " ".join([TEMPLATES["mit"], "All rights reserved. Licensed under the MIT License.", "filler words here " * 40] * 6000)
    assert len(text) > 9_000_000
    began = time.time()
    got = found_in([text])[0]
    assert time.time() - began < 120
    assert sum(x["template"] == "mit" for x in got) == 6000


def test_every_changed_copy_keeps_its_prints():
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 8, 13, 30, 77, 160):
        words = [f"u{i}" for i in range(n)]
        index = L.PrintIndex({"t": " ".join(words)})
        for _ in range(30):
            places = rng.sample(range(n), L.places_changed(n, L.COVERAGE))
            text = pa.array([" ".join("x" if i in places else w for i, w in enumerate(words))])
            offsets, hashes, _ = L.bare_words(text)
            assert len(np.unique(index.hits(offsets, hashes)[3])) >= index.least[0] >= 1
