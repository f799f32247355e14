"""Privacy scanning of text and code changes as Spark DataFrame operators."""

from .operators import find_sensitive, issue_rows, outbound_filter, redact, scan_rules
from .plans import check_changes, check_packages
from .rules import DEFAULT_RULES, Rule, rules_frame, ruleset_version

__all__ = [
    "DEFAULT_RULES", "Rule", "check_changes", "check_packages", "find_sensitive", "issue_rows",
    "outbound_filter", "redact", "rules_frame", "ruleset_version", "scan_rules",
]
