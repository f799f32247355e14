"""Run-level results: summary, gate, statistics, numbered issue report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import SEVERITIES
from ..session import written_once
from .ordering import with_offsets
from .scan import issue_rows

RUN_KEYS = ("repo_id", "commit_no")


def severity_rank(severity: Column) -> Column:
    rank = F.when(severity == SEVERITIES[0], 0)
    for i, name in enumerate(SEVERITIES[1:], start=1):
        rank = rank.when(severity == name, i)
    return rank


def risk_name(rank: Column) -> Column:
    name = F.when(rank == 1, F.lit(SEVERITIES[1])).when(rank == 2, F.lit(SEVERITIES[2]))
    return name.otherwise(F.lit(SEVERITIES[0]))


def _count_severity(name: str) -> Column:
    return F.sum(F.size(F.filter(F.col("issues"), lambda i: i.severity == name)))


def run_text(n_issues: Column, n_high: Column, n_medium: Column, n_files: Column) -> Column:
    clean = F.concat(
        F.lit("No privacy issues found across "), n_files.cast("string"),
        F.lit(" scanned file(s)."),
    )
    found = F.concat(
        F.lit("Found "), n_issues.cast("string"), F.lit(" issue(s) across "),
        n_files.cast("string"), F.lit(" file(s) — "), n_high.cast("string"), F.lit(" high, "),
        n_medium.cast("string"), F.lit(" medium."),
    )
    return F.when(n_issues == 0, clean).otherwise(found)


def run_summary(file_results: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per run from rows with ``overall_risk`` and ``issues``.

    Counts, sums and a maximum only: partial aggregates run before the shuffle,
    so a run's size does not matter. ``blocked`` is the gate.
    """
    totals = file_results.groupBy(*run_keys).agg(
        F.max(severity_rank(F.col("overall_risk"))).alias("_rank"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.size("issues")).alias("n_issues"),
        _count_severity("HIGH").alias("n_high"),
        _count_severity("MEDIUM").alias("n_medium"),
    )
    return totals.select(
        *run_keys,
        risk_name(F.col("_rank")).alias("overall_risk"),
        run_text(F.col("n_issues"), F.col("n_high"), F.col("n_medium"), F.col("n_files"))
        .alias("summary"),
        "n_files", "n_issues", "n_high", "n_medium",
        (F.col("_rank") == 2).alias("blocked"),
    )


def number_issues(
    file_results: DataFrame,
    run_keys: Sequence[str] = RUN_KEYS,
    index_col: str = "file_idx",
    written: bool = False,
) -> DataFrame:
    """All issues of a run numbered from 1, by file order then rule order.

    The rows with issues are written once first; ``written`` says that
    ``file_results`` already is a stored table or checkpoint.
    """
    sized = file_results.select(
        *run_keys, index_col, "issues", F.size("issues").alias("_size")
    ).where(F.col("_size") > 0)
    if not written:
        sized = written_once(sized)
    placed = with_offsets(sized, run_keys, index_col, "_size", "_before")
    return issue_rows(placed, *run_keys, index_col, "_before").select(
        *run_keys,
        (F.col("_before") + F.col("issue_pos") + 1).alias("issue_no"),
        index_col,
        "file", "rule_id", "severity", "line_hint", "issue", "fix", "regulation",
    )


def run_stats(file_results: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Files seen, model calls and cache hits of each run."""
    return file_results.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("called")).alias("model_calls"),
        F.count_if(F.col("route") == "cached").alias("cache_hits"),
    )


def findings_cube(
    found: DataFrame, dims: Sequence[str] = ("category", "severity"), findings_col: str = "findings"
) -> DataFrame:
    """Findings counted by all combinations of ``dims``: ``level`` is their ``grouping_id``, a bit
    for each dimension summed over, whose column is null.

    Findings are summed by all dimensions first, so the rows that the cube multiplies are few.
    """
    rows = found.select(F.explode(findings_col).alias("_f")).select(
        *[F.col(f"_f.{d}").alias(d) for d in dims], F.length("_f.matched_text").alias("_chars")
    )
    base = rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.sum("_chars").alias("_chars"))
    return base.cube(*dims).agg(
        F.grouping_id().alias("level"), F.sum("_n").alias("n_findings"), F.sum("_chars").alias("n_chars")
    )
