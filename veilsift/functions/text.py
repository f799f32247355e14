"""Text projections: added lines, hints, entropy, hashing, escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import EXAMPLE_ALLOWLIST, SAFE_REFERENCES, TRUNCATION_MARKER
from .regex import NOT_SPACE, quoted


# What the ECMAScript trim strips: the ASCII spaces and the Unicode ones.
_TRIMMED = "".join(map(chr, (
    *range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000, 0xFEFF,
)))


def trim_text(text: Column) -> Column:
    """Strip every Unicode space at both ends (plain ``trim`` strips U+0020 only)."""
    return F.btrim(text, F.lit(_TRIMMED))


def is_blank(text: Column) -> Column:
    """Null, empty or spaces only; looks no further than the first other character."""
    return ~F.coalesce(text.rlike(NOT_SPACE), F.lit(False))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def added_lines(diff: Column) -> Column:
    """Lines a diff adds, marker included; file headers (``+++``) are not lines."""
    return F.filter(
        split_lines(diff),
        lambda line: line.startswith("+") & ~line.startswith("+++"),
    )


def added_text(diff: Column) -> Column:
    return F.array_join(added_lines(diff), "\n")


def hint_text(line: Column) -> Column:
    """An added line without its marker and outer spaces."""
    return trim_text(F.regexp_replace(line, r"^\+", ""))


def secret_candidate(match: Column) -> Column:
    """The value inside a match: quotes dropped, trimmed."""
    return trim_text(F.regexp_replace(match, "['\"]", ""))


def shannon_entropy(text: Column) -> Column:
    """Bits per character over code points; 0 for empty text."""
    n = F.length(text)
    # each step binds its result as a lambda variable, so nothing is computed twice
    counts = F.filter(
        F.transform(
            F.array_distinct(F.split(text, "")),
            lambda ch: n - F.length(F.replace(text, ch, F.lit(""))),
        ),
        lambda c: c > 0,  # empty text splits into one empty piece
    )
    shares = F.transform(counts, lambda c: c.cast("double") / n)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def is_example(line: Column) -> Column:
    """The line holds a placeholder from the allowlist."""
    return F.upper(line).rlike(quoted(tuple(v.upper() for v in EXAMPLE_ALLOWLIST)))


def is_safe_reference(line: Column) -> Column:
    """The line reads its secret from configuration."""
    return line.rlike(quoted(SAFE_REFERENCES))


def content_hash(diff: Column) -> Column:
    return F.sha2(diff, 256)


def cut_diff(diff: Column, max_chars: int | None = None) -> Column:
    """Bound a diff to ``max_chars`` with a marker; by default it stays whole."""
    if max_chars is None:
        return diff
    return F.when(
        F.length(diff) > max_chars,
        F.concat(F.substring(diff, 1, max_chars), F.lit(TRUNCATION_MARKER)),
    ).otherwise(diff)


def name_at_version(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("@"), version)


def review_prompt(path: Column, diff: Column) -> Column:
    """Outbound text for the review of one file."""
    return F.concat(F.lit('Review this diff for file "'), path, F.lit('":\n\n'), diff)


def package_prompt(dependency_list: Column, reference: Column) -> Column:
    """Outbound text for scoring a dependency list against a reference document."""
    block = F.when(
        F.coalesce(reference, F.lit("")) == "",
        F.lit("Package reference: none."),
    ).otherwise(F.concat(F.lit("Package reference:\n\n"), reference))
    return F.concat(
        block, F.lit("\n\nScore these npm packages for privacy risk:\n\n"), dependency_list
    )


def html_escape(text: Column) -> Column:
    """Escape ``& < > "``; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def strip_code_fences(response: Column) -> Column:
    """A model reply without Markdown fences, trimmed."""
    return trim_text(F.regexp_replace(response, "```json|```", ""))


def plain_number(value: Column) -> Column:
    """A double as text, whole numbers without a fraction part."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
