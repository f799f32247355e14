"""Operators: DataFrame in, DataFrame out, lazily."""

from .ordering import with_offsets
from .packages import (
    attach_reference, attach_reports, clause_rows, dependency_report, package_results,
    parse_package_verdicts, report_display, score_counts,
)
from .redact import find_sensitive, outbound_by_mode, outbound_filter, redact
from .rollup import findings_cube, number_issues, run_stats, run_summary
from .route import merge_verdicts, parse_verdict, route
from .scan import issue_rows, rule_hits, scan_rules

__all__ = [
    "attach_reference", "attach_reports", "clause_rows", "dependency_report", "find_sensitive",
    "findings_cube",
    "issue_rows", "merge_verdicts", "number_issues", "outbound_by_mode", "outbound_filter",
    "package_results", "parse_package_verdicts", "parse_verdict", "redact", "report_display", "route", "rule_hits",
    "run_stats", "run_summary", "scan_rules", "score_counts", "with_offsets",
]
