"""Structured Streaming forms of the scan."""

from .continuous import issues_per_window, once_per_diff, scan_stream, start_cached_scan

__all__ = ["issues_per_window", "once_per_diff", "scan_stream", "start_cached_scan"]
