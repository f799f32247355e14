"""The stages on planted rows, and the whole run."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    parts = {"aa": "ta ko mi ra shi no ka".split(), "bb": "str ung ach sch ein pf".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(2, 5)))
    text = lambda lang, n=90: " ".join(word(lang) for _ in range(n))
    rows = [(k, text("aa" if k % 2 else "bb"), "aa" if k % 2 else "bb", "s") for k in range(60)]
    item = text("aa", 40)
    rows += [
        (60, rows[1][1], "aa", "s"), (61, rows[2][1] + " changed", None, "s"), (62, "too short", "aa", "s"),
        (63, text("aa") + " " + item, "aa", "s"), (64, None, "aa", "s"), (65, "12345 !!!", "bb", "s"), (66, "ta ko " * 80, "aa", None),
    ]
    rows = [(i, t, lang, s, len(t) if t else None, "extra") for i, t, lang, s in rows]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string") \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "tokens"]
    gone = {}
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids = {r.doc_id for r in docs.collect()}
        left = [r.doc_id for r in after.collect()]
        assert len(left) == len(set(left))
        gone[name] = ids - set(left)
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert gone == {"language": {64, 65}, "quality": {62, 66}, "near_duplicates": {60, 61}, "decontamination": {63}}


def test_run(spark, folder):
    rows = entry.queries()["pipeline"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == list(range(60)) and all(r.n_tokens > 0 for r in rows)
    assert P.ORACLE_SQL is None


def test_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
