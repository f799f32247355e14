"""The result cache: a Parquet table keyed by content hash and rule-set version.

The table is partitioned by the first characters of the hash. A job reads the partitions of
its own hashes and appends small files to them; ``compact_in_place`` replaces a partition by
one row per key. A stored result depends on nothing but its key, so a retried or
restarted job, which may append its entries twice, leaves a table that reads the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import CACHE_VERSION, DEFAULT_RULES, ruleset_version
from ..schemas import SCAN_CACHE

#: Characters of a hash that name its partition: 256 partitions.
PREFIX_CHARS = 2
#: Files in a partition that ``compact_cache`` leaves alone.
MAX_FILES = 8

_STORED = T.StructType([
    *SCAN_CACHE.fields, T.StructField("part", T.StringType()), T.StructField("prefix", T.StringType()),
])
_KEY = ("prefix", "diff_hash", "version", "ruleset_version")


def prefix_of(diff_hash: Column) -> Column:
    """The partition of a hash."""
    return F.lower(F.substring(diff_hash, 1, PREFIX_CHARS))


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_entries(cache: DataFrame, version: str | None = None) -> DataFrame:
    """Current entries only, one per hash, the newest one winning.

    A table's partition column stays a key, so that a filter on it reaches the files.
    """
    version = version or ruleset_version(DEFAULT_RULES)
    current = cache.where(
        (F.col("version") == CACHE_VERSION) & (F.col("ruleset_version") == version)
    )
    keys = [c for c in ("prefix", "diff_hash") if c in cache.columns]
    return current.groupBy(*keys).agg(
        F.max_by("result", "written_at").alias("result"),
        F.max("written_at").alias("written_at"),
    )


def load_cache(
    spark: SparkSession, path: str, version: str | None = None, skip_part: str | None = None,
    prefixes: Iterable[str] | None = None,
) -> DataFrame:
    """Cached results; a missing table or another version reads as empty.

    ``prefixes`` names the partitions to read. ``skip_part`` leaves out what an earlier try
    of the same job wrote.
    """
    raw = _table(spark, path)
    if raw is None:
        raw = spark.createDataFrame([], _STORED)
    if prefixes is not None:
        raw = raw.where(F.col("prefix").isin(list(prefixes)))
    if skip_part is not None:
        raw = raw.where(F.col("part") != skip_part)
    return latest_entries(raw, version)


def cache_entries(results: DataFrame, version: str | None = None) -> DataFrame:
    """Rows to store for ``(diff_hash, overall_risk, summary, issues)``; LOW is never stored."""
    version = version or ruleset_version(DEFAULT_RULES)
    return results.where("overall_risk <> 'LOW'").select(
        "diff_hash",
        F.lit(CACHE_VERSION).alias("version"),
        F.lit(version).alias("ruleset_version"),
        F.current_timestamp().alias("written_at"),
        F.struct("overall_risk", "summary", "issues").alias("result"),
    )


def _write(rows: DataFrame, path: str, mode: str, replaced: str = "static") -> None:
    (
        rows.hint("rebalance", "prefix").sortWithinPartitions("prefix", "diff_hash")
        .write.mode(mode).option("partitionOverwriteMode", replaced)
        .partitionBy("prefix").parquet(path)
    )


def append_cache(entries: DataFrame, path: str, part: str) -> None:
    """Add one job's entries, marked with ``part``; readers and compaction let the newest win."""
    marked = entries.withColumns({"part": F.lit(part), "prefix": prefix_of(F.col("diff_hash"))})
    _write(marked, path, "append")


def compact_cache(spark: SparkSession, path: str, out_path: str, version: str | None = None) -> None:
    """Write one current row per hash to a new table."""
    version = version or ruleset_version(DEFAULT_RULES)
    current = load_cache(spark, path, version).select(
        "diff_hash",
        F.lit(CACHE_VERSION).alias("version"),
        F.lit(version).alias("ruleset_version"),
        "written_at",
        "result",
        F.lit("compacted").alias("part"),
        "prefix",
    )
    _write(current, out_path, "overwrite")


def crowded_prefixes(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> list[str]:
    """The partitions to compact: of many files, of which the largest has less than half the rows.

    So a partition is rewritten only after it has about doubled, and the rows rewritten over
    the life of a table grow with its size times the logarithm of that, however many appends.
    """
    table = _table(spark, path)
    if table is None:
        return []
    files = table.groupBy("prefix", F.col("_metadata.file_path").alias("file")).count()
    crowded = files.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.max("count").alias("largest"), F.sum("count").alias("rows")
    ).where((F.col("n") > max_files) & (2 * F.col("largest") < F.col("rows")))
    return sorted(r.prefix for r in crowded.select("prefix").collect())  # at most one per partition


def compact_in_place(spark: SparkSession, path: str, prefixes: Iterable[str] | None = None) -> None:
    """Keep one row per hash and version, the newest, in the partitions named or in all.

    Partitions are replaced by a dynamic overwrite when the job commits: a try that fails
    before leaves the table as it was. If the commit itself is cut off, a partition may be
    missing; its diffs are scanned anew. No other job may append to these partitions meanwhile.
    """
    rows = _table(spark, path)
    if rows is None:
        return
    if prefixes is not None:
        rows = rows.where(F.col("prefix").isin(list(prefixes)))
    rest = [c for c in _STORED.names if c not in _KEY]
    newest = rows.groupBy(*_KEY).agg(F.max_by(F.struct(*rest), "written_at").alias("_r"))
    _write(newest.select(*_KEY, "_r.*").select(*_STORED.names), path, "overwrite", "dynamic")


def clear_cache(spark: SparkSession, path: str) -> None:
    """Replace the whole table by an empty one."""
    _write(spark.createDataFrame([], _STORED), path, "overwrite")
