"""The whole dependency check: manifests, reference, verdicts, policy reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import package_prompt
from ..operators.joins import join_unique
from ..operators.packages import package_results, report_display, score_counts
from ..sources.manifests import dependency_lists, manifest_dependencies
from ..sources.package_reference import reference_entry, unique_reference
from ..sources.policy_reports import report_envelopes


@dataclass(frozen=True)
class PackageCheck:
    """Lazy results of one dependency check."""

    results: DataFrame
    counts: DataFrame
    reports: DataFrame
    empty_manifests: DataFrame


def check_packages(
    manifests: DataFrame,
    reference: DataFrame,
    verdicts: DataFrame,
    policy_reports: DataFrame,
) -> PackageCheck:
    """Score every dependency of every manifest and attach policy reports."""
    dependencies, known = manifest_dependencies(manifests), unique_reference(reference)
    results = package_results(dependencies, known, verdicts, report_envelopes(policy_reports))
    return PackageCheck(
        results=results,
        counts=score_counts(package_results(dependencies, known, verdicts), "manifest_id"),
        reports=report_display(results),
        empty_manifests=dependency_lists(manifests).where("n_dependencies = 0"),
    )


def scoring_requests(manifests: DataFrame, reference: DataFrame | str = "") -> DataFrame:
    """The text to send for each manifest that has dependencies.

    ``reference`` is a parsed reference table, of which each manifest gets the entries of its
    own dependencies, in the reference's order; or a text that all manifests get whole.
    """
    wanted = dependency_lists(manifests).where("n_dependencies > 0")
    if isinstance(reference, str):
        return wanted.select(
            "manifest_id", package_prompt(F.col("dependency_list"), F.lit(reference)).alias("request_text"),
        )
    known = unique_reference(reference).select("name", "ordinal", reference_entry().alias("entry"))
    matched = join_unique(
        manifest_dependencies(manifests).select("manifest_id", "name"), known, "name", "inner"
    )
    # a manifest's entries are part of its one prompt
    entries = matched.groupBy("manifest_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "name", "entry"))).alias("_e")
    ).select(
        "manifest_id", F.array_join(F.transform("_e", lambda e: e.entry), "\n\n").alias("_reference")
    )
    return join_unique(wanted, entries, "manifest_id").select(
        "manifest_id", package_prompt(F.col("dependency_list"), F.col("_reference")).alias("request_text")
    )
