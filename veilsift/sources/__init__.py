"""Sources and sinks."""

from .diffs import changed_files, pick_diff, prepare_files, read_file_diffs
from .manifests import dependency_lists, manifest_dependencies, read_manifests
from .package_reference import parse_reference, read_reference, unique_reference
from .policy_reports import read_policy_reports, report_envelopes
from .scan_cache import (
    append_cache, cache_entries, clear_cache, compact_cache, compact_in_place, crowded_prefixes, load_cache,
)

__all__ = [
    "append_cache", "cache_entries", "changed_files", "clear_cache", "compact_cache",
    "compact_in_place", "crowded_prefixes",
    "dependency_lists", "load_cache", "manifest_dependencies", "parse_reference", "pick_diff",
    "prepare_files", "read_file_diffs", "read_manifests", "read_policy_reports",
    "read_reference", "report_envelopes", "unique_reference",
]
