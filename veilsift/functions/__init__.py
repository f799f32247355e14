"""Column functions; all of them stay inside the JVM."""

from .paths import base_name, is_doc_file, path_risk, should_skip
from .regex import to_java
from .text import (
    added_lines, added_text, content_hash, cut_diff, hint_text, html_escape, is_blank, is_example,
    is_safe_reference, name_at_version, package_prompt, plain_number, review_prompt,
    secret_candidate, shannon_entropy, split_lines, strip_code_fences, trim_text,
)

__all__ = [
    "added_lines", "added_text", "base_name", "content_hash", "cut_diff", "hint_text",
    "html_escape", "is_blank", "is_doc_file", "is_example", "is_safe_reference",
    "name_at_version", "package_prompt", "path_risk", "plain_number", "review_prompt",
    "secret_candidate", "shannon_entropy", "should_skip", "split_lines", "strip_code_fences",
    "to_java", "trim_text",
]
