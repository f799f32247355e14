"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from veilsift.operators.redact import redact
from veilsift.operators.rollup import run_summary
from veilsift.operators.scan import issue_rows, scan_rules
from veilsift.operators.once import computed_once
from veilsift.plans import review_requests
from veilsift.plans.check_changes import _looked_up, scan_distinct
from veilsift.schemas import RESULT
from veilsift.sources import append_cache, cache_entries, load_cache, prepare_files


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files"))
    spark.range(50).select(
        (F.col("id") % 3).cast("int").alias("repo_id"), F.lit(1).alias("commit_no"),
        F.col("id").alias("file_idx"), F.lit("src/a.ts").alias("file_path"),
        F.lit("+gtag(1)").alias("diff"), F.lit("wide").alias("unused"),
    ).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_needs_no_shuffle(files):
    text = plan(issue_rows(scan_rules(files), "file_idx"))
    assert "Exchange" not in text and "Python" not in text and "Cartesian" not in text


def test_columns_are_pruned(files):
    text = plan(scan_rules(files).select("file_idx", "overall_risk"))
    schema = text[text.index("ReadSchema"):].split(">")[0]
    assert "unused" not in schema and "repo_id" not in schema and "diff" in schema


def test_filters_on_results_do_not_repeat_the_scan(files):
    plain = plan(scan_rules(files)).count("RLIKE")
    assert plain > 40
    for df in (
        scan_rules(files).where("overall_risk = 'HIGH'"),
        issue_rows(scan_rules(files), "file_idx").where("severity = 'HIGH'"),
    ):
        assert plan(df).count("RLIKE") < plain * 1.1
    found = plan(redact(files, "diff")).count("RLIKE")
    assert plan(redact(files, "diff").where("has_high")).count("RLIKE") == found


def test_filters_on_inputs_reach_the_source(files):
    text = plan(scan_rules(files).where("repo_id = 1"))
    assert "EqualTo(repo_id,1)" in text


def test_run_summary_is_one_partial_aggregate(files):
    text = plan(run_summary(scan_rules(prepare_files(files))))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_max" in text and "partial_sum" in text


def test_computed_once_keeps_rows(spark):
    df = spark.range(10).withColumn("a", F.col("id") + 1).withColumn("b", F.col("id") + 2)
    out = computed_once(df, "a", "b")
    assert out.columns == df.columns and sorted(out.collect()) == sorted(df.collect())


def test_cache_reads_the_partitions_of_its_hashes(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.range(300).select(
        F.sha2(F.col("id").cast("string"), 256).alias("diff_hash"), F.lit("HIGH").alias("overall_risk"),
        F.lit("s").alias("summary"), F.array().cast(RESULT["issues"].dataType).alias("issues"),
    )
    append_cache(cache_entries(rows), path, "p")
    text = plan(load_cache(spark, path, prefixes=["0a", "ff"]))
    assert "PartitionFilters: [prefix#" in text.replace("isnotnull(", "") and "IN (0a,ff)" in text
    read = load_cache(spark, path, prefixes=["0a", "ff"])
    assert {r.prefix for r in read.collect()} <= {"0a", "ff"} and read.count() < 20
    # a filter behind the choice of the newest entry reaches the files, too
    assert "IN (0a,ff)" in plan(load_cache(spark, path).where(F.col("prefix").isin("0a", "ff")))

    owned = rows.limit(5).select("diff_hash")
    looked = _looked_up(owned, load_cache(spark, path))
    text = looked._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 1 and "LeftSemi" in text
    assert text.index("LeftOuter") < text.index("Aggregate [") < text.index("LeftSemi")  # cut before results move


def test_texts_are_in_no_aggregate(spark, files):
    prepared = prepare_files(files)
    narrow = prepared.select("repo_id", "commit_no", "file_idx", "file_path", "diff_hash")
    scanned = scan_distinct(prepared, narrow, ["repo_id", "commit_no", "file_idx"])
    routed = narrow.withColumn("route", F.lit("review"))
    for df in (scanned, review_requests(routed, files=prepared)):
        text = plan(df)
        lines = [x for x in text.split("\n") if "Aggregate" in x]
        assert lines and not any(re.search(r"\bdiff#", x) for x in lines)
        assert "left_semi" in text.lower() or "LeftSemi" in text
