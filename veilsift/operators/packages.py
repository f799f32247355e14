"""Dependency scoring: reference and verdict joins, report display, counts.

Scores come from a verdict table; nothing here invents one. Package names are
skewed (a few names sit in most manifests), so every join side is reduced to one
row per key first and joined with ``join_unique``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsontext import parse_whole
from ..functions.text import plain_number, strip_code_fences
from ..schemas import PACKAGE_VERDICT
from .joins import join_unique
from .once import computed_once

UNSCORED = "UNSCORED"
SCORE_ORDER = ("HIGH_RISK", "CAUTION", "SAFE", UNSCORED)
TOP_CLAUSES = 5


def score_rank(score: Column) -> Column:
    """Position in the fixed report order, high risk first."""
    rank = F.when(score == SCORE_ORDER[0], 0)
    for i, name in enumerate(SCORE_ORDER[1:], start=1):
        rank = rank.when(score == name, i)
    return rank.otherwise(len(SCORE_ORDER))


def parse_package_verdicts(replies: DataFrame, response_col: str = "response") -> DataFrame:
    """One row per package object in a reply; malformed replies give none."""
    items = parse_whole(strip_code_fences(F.col(response_col)), T.ArrayType(PACKAGE_VERDICT))
    keep = [c for c in replies.columns if c != response_col]
    parsed = computed_once(replies.select(*keep, items.alias("_items")), "_items")
    return (
        parsed.select(*keep, F.explode("_items").alias("_v")).select(*keep, "_v.*")
        .withColumnRenamed("privacyPolicyUrl", "privacy_policy_url")
    )


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def attach_reference(dependencies: DataFrame, reference: DataFrame) -> DataFrame:
    """Add the reference's entry for each dependency, matched by name."""
    known = reference.select("name", "category", "status", "privacy_url", "security_url")
    return join_unique(dependencies, known, "name")


FIELDS = ("score", "reason", "alternative", "regulation", "privacy_policy_url")


def _with_version(verdicts: DataFrame) -> DataFrame:
    if "version" in verdicts.columns:
        return verdicts
    return verdicts.withColumn("version", F.lit(None).cast("string"))


def _judged(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict per key and version; of several the most severe."""
    order = F.struct(score_rank(F.col("score")).alias("rank"), F.struct(*FIELDS).alias("fields"))
    return _with_version(verdicts).groupBy(*keys, "version").agg(F.min(order).alias("_v")).select(
        *keys, "version", "_v.rank", "_v.fields"
    )


def _by_key(judged: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the verdict of each version, and the most severe for all others."""
    result = F.struct(*fields)
    known = F.col("version").isNotNull()
    return judged.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.when(known, F.struct(F.col("version"), result.alias("result"))))
        ).alias("_versions"),
        F.min_by(result, F.struct("rank", "version")).alias("_any"),
    )


def _chosen() -> Column:
    return F.coalesce(F.col("_versions")[F.col("version")], F.col("_any"))


def package_results(
    dependencies: DataFrame, reference: DataFrame, verdicts: DataFrame,
    envelopes: DataFrame | None = None,
) -> DataFrame:
    """Score, reason and policy URL per dependency, and its policy report if ``envelopes`` are given.

    A verdict for the dependency's own version counts; without one, the most severe of the
    package's verdicts does, so a risk is never hidden. The reference's URL comes first,
    then the verdict's. ``verdicts`` may carry ``manifest_id``, and then counts for that
    manifest only.

    Reference, verdicts and reports meet per package, where all are small; the
    dependencies, a fact table, are joined once.
    """
    if "manifest_id" in verdicts.columns:
        return _results_per_manifest(dependencies, reference, verdicts, envelopes)
    known = reference.select("name", "privacy_url")
    judged = known.join(_judged(verdicts, ["name"]), "name", "full").select(
        "name", "version", F.coalesce("rank", F.lit(len(SCORE_ORDER))).alias("rank"),
        F.coalesce("fields.score", F.lit(UNSCORED)).alias("score"),
        *[F.col(f"fields.{c}").alias(c) for c in FIELDS[1:-1]],
        F.coalesce(_given(F.col("privacy_url")), _given(F.col("fields.privacy_policy_url")))
        .alias("privacy_policy_url"),
    )
    fields = list(FIELDS)
    if envelopes is not None:
        judged = attach_reports(judged, envelopes)
        fields.append("privacy_report")
    packages = _by_key(judged, ["name"], fields)
    joined = join_unique(dependencies, packages, "name").withColumn("_r", _chosen())
    return joined.select(
        *dependencies.columns, F.coalesce("_r.score", F.lit(UNSCORED)).alias("score"),
        *[F.col(f"_r.{c}").alias(c) for c in fields[1:]],
    )


def _results_per_manifest(dependencies, reference, verdicts, envelopes):
    keys = ["manifest_id", "name"]
    judged = _by_key(_judged(verdicts, keys).select(*keys, "version", "rank", "fields.*"), keys, list(FIELDS))
    joined = join_unique(attach_reference(dependencies, reference), judged, keys).withColumn("_r", _chosen())
    results = joined.select(
        *dependencies.columns, F.coalesce("_r.score", F.lit(UNSCORED)).alias("score"),
        *[F.col(f"_r.{c}").alias(c) for c in FIELDS[1:-1]],
        F.coalesce(_given(F.col("privacy_url")), _given(F.col("_r.privacy_policy_url")))
        .alias("privacy_policy_url"),
    )
    return results if envelopes is None else attach_reports(results, envelopes)


def attach_reports(results: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Add the policy report of each result that has a URL; null elsewhere.

    Results without a URL match nothing and are spread over many keys of their own, so
    that they do not pile up on a null key.
    """
    fields = [c for c in envelopes.columns if c != "url"]
    side = envelopes.select(F.col("url").alias("_url"), F.struct(*fields).alias("privacy_report"))
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*results.columns), F.lit(1024)).cast("string"))
    keyed = results.withColumn("_url", F.coalesce(_given(F.col("privacy_policy_url")), spread))
    return join_unique(keyed, side, "_url").drop("_url")


def score_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Number of packages per score."""
    return results.groupBy(*keys).agg(
        *[F.count_if(F.col("score") == s).alias(f"n_{s.lower()}") for s in SCORE_ORDER]
    )


def dependency_report(results: DataFrame) -> DataFrame:
    """Results in report order; the sort continues below the score, so it splits."""
    return results.withColumn("score_rank", score_rank(F.col("score"))).orderBy(
        "score_rank", "name", "version", "manifest_id"
    )


def clause_label(clause: Column) -> Column:
    return F.coalesce(clause["classification"], clause["category"], clause["type"], F.lit("Clause"))


def clause_text(clause: Column) -> Column:
    return F.coalesce(clause["plain_insight"], clause["summary"], clause["text"], F.lit(""))


def report_display(results: DataFrame, top_clauses: int | None = TOP_CLAUSES) -> DataFrame:
    """Display fields of every result that has a policy URL or a report.

    The display shows the first ``top_clauses`` clauses; ``None`` shows all.
    """
    rpt = F.col("privacy_report")
    data = rpt["report"]
    clauses = data["clauses"]
    n_clauses = F.when(clauses.isNull(), F.lit(0)).otherwise(F.size(clauses))
    breakdown = F.array_join(
        F.transform(
            F.map_entries(data["risk_breakdown"]),
            lambda e: F.concat(e.key, F.lit(": "), plain_number(e.value)),
        ),
        ", ",
    )
    shown = results.where(F.col("privacy_policy_url").isNotNull() | rpt.isNotNull())
    return shown.withColumns({
        "report_available": rpt.isNotNull(),
        "grade": F.coalesce(data["grade"], F.lit("N/A")),
        "score_text": F.when(
            data["score"].isNotNull(), F.concat(plain_number(data["score"]), F.lit("/100"))
        ).otherwise(F.lit("")),
        "risk_level": data["risk_level"],
        "domain": data["domain"],
        "report_summary": data["summary"],
        "breakdown": F.coalesce(breakdown, F.lit("")),
        "http_status": rpt["status_code"],
        "report_error": rpt["error"],
        "top_clauses": F.transform(
            clauses if top_clauses is None else F.slice(clauses, 1, top_clauses),
            lambda c: F.struct(
                clause_label(c).alias("label"),
                clause_text(c).alias("text"),
                c["fine_label"].alias("fine_label"),
            ),
        ),
        "more_clauses": F.lit(0) if top_clauses is None else F.greatest(n_clauses - top_clauses, F.lit(0)),
    }).drop("privacy_report")


def clause_rows(displayed: DataFrame, *keys: str) -> DataFrame:
    """One row per shown clause, numbered from 1."""
    return displayed.select(
        *keys, "more_clauses", F.posexplode("top_clauses").alias("_p", "_c")
    ).select(*keys, (F.col("_p") + 1).alias("clause_no"), "_c.*", "more_clauses")
