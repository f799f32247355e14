"""Which files need a deeper review, and merging a reviewer's verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import parse_whole
from ..functions.text import strip_code_fences
from ..schemas import MODEL_RESULT
from .joins import join_unique
from .once import computed_once
from .scan import risk_of

REVIEW = "review"


def route(is_doc: Column, overall_risk: Column, risk_of_path: Column) -> Column:
    """``local_doc``, ``local_high``, ``local_low_path`` or ``review``."""
    return (
        F.when(is_doc, F.lit("local_doc"))
        .when(overall_risk == "HIGH", F.lit("local_high"))
        .when((overall_risk == "LOW") & (risk_of_path == "LOW"), F.lit("local_low_path"))
        .otherwise(F.lit(REVIEW))
    )


def parse_verdict(response: Column) -> Column:
    """A reply as a struct, null when it is not valid JSON."""
    return parse_whole(strip_code_fences(response), MODEL_RESULT)


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """One parsed reply per ``diff_hash``: a usable one (with issues) before one that is only
    readable, then the newest by ``arrived_at`` where the table has it, then by text.

    Partial aggregation leaves one reply per hash and task before the shuffle.
    """
    newest = F.col("arrived_at") if "arrived_at" in verdicts.columns else F.lit(0)
    parsed = computed_once(
        verdicts.withColumn("verdict", parse_verdict(F.col("response"))), "verdict"
    )
    rank = F.when(F.col("verdict.issues").isNotNull(), 2).when(F.col("verdict").isNotNull(), 1).otherwise(0)
    return parsed.groupBy("diff_hash").agg(
        F.max_by("verdict", F.struct(rank.alias("rank"), newest.alias("at"), "response")).alias("verdict")
    )


def merge_issues(local: Column, verdict_issues: Column) -> Column:
    """All local issues, then the reviewer's whose text is not a local one.

    Duplicates inside the reviewer's own list stay.
    """
    known = F.transform(local, lambda i: i.issue)
    new = F.filter(
        verdict_issues,
        lambda v: ~F.array_contains(known, F.coalesce(v.issue, F.lit(""))),
    )
    return F.concat(local, F.transform(
        new,
        lambda v: F.struct(
            F.lit(None).cast("int").alias("rule_idx"),
            F.lit(None).cast("string").alias("rule_id"),
            v.file.alias("file"),
            v.line_hint.alias("line_hint"),
            v.severity.alias("severity"),
            v.issue.alias("issue"),
            v.fix.alias("fix"),
            v.regulation.alias("regulation"),
        ),
    ))


def merge_verdicts(scanned: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Fold reviewer replies into scanned rows that have ``route`` and ``diff_hash``.

    Rows not routed to review, and routed rows without a usable reply, keep the
    local result. Adds ``merged`` (reply used) and ``called`` (reply readable).
    """
    v = latest_verdicts(verdicts)
    joined = join_unique(scanned, v, "diff_hash")
    reviewed = F.col("route") == REVIEW
    readable = reviewed & F.col("verdict").isNotNull()
    usable = readable & F.col("verdict.issues").isNotNull()
    issues = F.when(usable, merge_issues(F.col("issues"), F.col("verdict.issues"))).otherwise(
        F.col("issues")
    )
    return (
        joined.withColumns({"called": readable, "merged": usable})
        .withColumn("issues", issues)
        .withColumn(
            "overall_risk",
            F.when(F.col("merged"), risk_of(F.col("issues"))).otherwise(F.col("overall_risk")),
        )
        .withColumn(
            "summary",
            F.when(F.col("merged"), F.col("verdict.summary")).otherwise(F.col("summary")),
        )
        .drop("verdict")
    )
