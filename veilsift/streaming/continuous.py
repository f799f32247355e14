"""Continuous scan: the batch operators on a stream of arriving diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import join_unique
from ..operators.scan import issue_rows, scan_rules
from ..rules import DEFAULT_RULES, Rule, ruleset_version
from ..schemas import RESULT
from ..sources.diffs import prepare_files
from ..sources.scan_cache import (
    append_cache, cache_entries, compact_in_place, crowded_prefixes, load_cache, prefix_of,
)


def scan_stream(
    files: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    max_chars: int | None = None,
) -> DataFrame:
    """Triage and scan a streaming ``file_diffs`` frame; stateless and row-local."""
    return scan_rules(prepare_files(files, max_chars), doc_col="is_doc", rules=rules)


def once_per_diff(prepared: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """Pass the first arrival of each diff; state is bounded by the watermark."""
    return prepared.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["diff_hash"])


def issues_per_window(
    scanned: DataFrame, ts_col: str, window: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Issue counts per time window and severity."""
    rows = issue_rows(scanned.withWatermark(ts_col, delay), ts_col)
    return rows.groupBy(F.window(ts_col, window).alias("w"), "severity").agg(
        F.count(F.lit(1)).alias("n_issues")
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "severity", "n_issues",
    )


def start_cached_scan(
    files: DataFrame,
    cache_path: str,
    out_path: str,
    checkpoint_path: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    max_chars: int | None = None,
    compact_every: int = 16,
    **trigger,
) -> StreamingQuery:
    """Give every arriving file a result; scan diffs that the cache does not hold yet.

    Each micro-batch is joined to the cache table once, so a diff with a stored result
    is not scanned again: its file gets the stored result and ``from_cache``. Of files
    with one diff in a batch, that of a code file is stored before that of documentation,
    then that of the first path. A batch reads the cache partitions of its own hashes only;
    every ``compact_every`` batches, partitions that have grown by many small files are
    compacted. A retried batch replaces its own output folder and does not look at cache
    entries of its own, so a retry gives what the first try would have given.
    """
    version = ruleset_version(tuple(rules))
    prepared = prepare_files(files, max_chars)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"batch-{batch_id}"
        mine = batch.select(prefix_of(F.col("diff_hash")).alias("p")).distinct().collect()  # at most 256
        known = load_cache(spark, cache_path, version, part, [r.p for r in mine]).select(
            "diff_hash", F.col("result").alias("_known")
        )
        met = join_unique(batch, known, "diff_hash")
        hit = F.col("_known").isNotNull()
        # a text with a stored result is not looked at
        scanned = scan_rules(
            met.withColumn("diff", F.when(~hit, F.col("diff")).otherwise("")), doc_col="is_doc", rules=rules
        )
        target = f"{out_path}/batch={batch_id}"
        scanned.withColumns({
            **{c: F.when(hit, F.col(f"_known.{c}")).otherwise(F.col(c)) for c in RESULT.names},
            "from_cache": hit,
        }).drop("diff", "_known").write.mode("overwrite").parquet(target)
        # the written rows, so that the scan is not run a second time
        fresh = spark.read.parquet(target).where("not from_cache")
        stored = fresh.groupBy("diff_hash").agg(
            F.min_by(F.struct(*RESULT.names), F.struct("is_doc", "file_path")).alias("_r")
        ).select("diff_hash", "_r.*")
        append_cache(cache_entries(stored, version), cache_path, part)
        if batch_id % compact_every == compact_every - 1:
            crowded = crowded_prefixes(spark, cache_path)
            if crowded:
                compact_in_place(spark, cache_path, crowded)

    return (
        prepared.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
