"""Path predicates: triage, documentation test, path risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import (
    DOC_SUFFIXES, HIGH_RISK_PATHS, LOW_RISK_PATHS, SKIP_INFIX, SKIP_NAMES, SKIP_SUFFIXES,
)


def _has_suffix(lowered: Column, suffixes: tuple[str, ...]) -> Column:
    body = "|".join(s[1:] for s in suffixes)
    return lowered.rlike(rf"\.(?:{body})\z")


def base_name(path: Column) -> Column:
    lowered = F.lower(path)
    last = F.element_at(F.split(lowered, "/"), -1)
    return F.when(last == "", lowered).otherwise(last)


def should_skip(path: Column) -> Column:
    """Assets, binaries, lockfiles and generated files: never scanned."""
    lowered = F.lower(path)
    return (
        _has_suffix(lowered, SKIP_SUFFIXES)
        | F.contains(lowered, F.lit(SKIP_INFIX))
        | base_name(path).isin(*SKIP_NAMES)
    )


def is_doc_file(path: Column) -> Column:
    return _has_suffix(F.lower(path), DOC_SUFFIXES)


def path_risk(path: Column) -> Column:
    """HIGH, LOW or MEDIUM by path words; HIGH words win."""
    lowered = F.lower(path)
    return (
        F.when(lowered.rlike("|".join(HIGH_RISK_PATHS)), F.lit("HIGH"))
        .when(lowered.rlike("|".join(LOW_RISK_PATHS)), F.lit("LOW"))
        .otherwise(F.lit("MEDIUM"))
    )
