"""The whole change check: triage, cache, scan, routing, verdict merge, rollup.

Data flow, with the text column followed closely because it is nearly all the
bytes:

1. Files are triaged and hashed where they are read.
2. Which file's text stands for a *distinct* diff is decided without text, and so is
   which diffs the cache knows. Only the texts left are fetched, by a semi-join, and
   scanned. No text is sorted or aggregated.
3. Everything after is narrow and read from a checkpoint, so text is read twice in
   all. Files are first grouped by what decides their result (run, hash,
   documentation or not, path risk), so a diff copied into a third of all files is
   one row per run when results are attached.
4. The per-file join back is the one place a hot key can meet many rows. Its
   other side has one row per key, and the write that follows needs no
   particular partitioning, so adaptive skew handling can split it.
5. File results, without text, are written once; the outputs are views of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import should_skip
from ..operators.joins import join_unique
from ..operators.once import owners, rows_of
from ..operators.rollup import RUN_KEYS, number_issues, run_summary
from ..operators.route import REVIEW, latest_verdicts, merge_issues, route
from ..operators.scan import local_summary, risk_of, scan_rules
from ..rules import DEFAULT_RULES, Rule, ruleset_version
from ..schemas import ISSUE, RESULT
from ..session import written_once
from ..sources.diffs import prepare_files
from ..sources.scan_cache import cache_entries, prefix_of

NOTHING_TO_SCAN = (
    "All changed files are non-code assets (images, lockfiles, etc). Nothing to scan."
)


@dataclass(frozen=True)
class ChangeCheck:
    """Results of one check, all read from one checkpoint."""

    file_results: DataFrame
    run_results: DataFrame
    issues: DataFrame
    new_cache_entries: DataFrame


def _result(risk: Column, summary: Column, issues: Column) -> Column:
    return F.struct(
        risk.alias("overall_risk"), summary.alias("summary"), issues.alias("issues")
    )


def _looked_up(owned: DataFrame, cache: DataFrame) -> DataFrame:
    """The owners with their stored result in ``cached``, from one read of the cache.

    The cache is first cut to the prefixes and then to the hashes of these diffs, so that
    results of others do not move.
    """
    hashes = owned.select("diff_hash").withColumn("prefix", prefix_of(F.col("diff_hash")))
    if "prefix" in cache.columns:
        found = [r.prefix for r in hashes.select("prefix").distinct().collect()]  # at most 256
        cache = cache.where(F.col("prefix").isin(found))
    met = cache.join(hashes.select("diff_hash"), "diff_hash", "left_semi")
    return join_unique(owned, met.select("diff_hash", F.col("result").alias("cached")), "diff_hash")


def scan_distinct(
    prepared: DataFrame,
    narrow: DataFrame,
    row_keys: Sequence[str],
    rules: Sequence[Rule] = DEFAULT_RULES,
    cache: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Every result a distinct diff can have, one row per ``diff_hash``.

    ``doc`` is the result for documentation files, ``code`` for others, ``merged``
    the reviewed one (null without a usable verdict), ``cached`` the stored one.
    Rules act independently, so the documentation result is the code result
    without the code-only rules and one scan serves both.

    ``narrow`` has the rows of ``prepared`` without text. The row to take a diff's text from is
    chosen on it; only texts without a stored result are fetched and scanned.
    """
    keys = [*row_keys, "file_path"]
    owned, hits = owners(narrow, "diff_hash", keys), None
    if cache is not None:
        owned = written_once(_looked_up(owned, cache))
        hits = owned.where(F.col("cached").isNotNull())
        owned = owned.where(F.col("cached").isNull()).drop("cached")
    fresh = rows_of(prepared, owned, ["diff_hash", *keys]).select("diff_hash", "diff")
    scanned = scan_rules(
        # the file a result is reported for is attached later
        fresh.withColumns({
            "_path": F.lit(None).cast("string"), "_doc": F.lit(False),
        }),
        path_col="_path", doc_col="_doc", rules=rules,
    )
    code_only = [i for i, r in enumerate(rules) if r.skip_on_docs]
    doc_issues = F.filter(F.col("issues"), lambda i: ~i.rule_idx.isin(*code_only)) if code_only \
        else F.col("issues")
    variants = scanned.select(
        "diff_hash",
        _result(F.col("overall_risk"), F.col("summary"), F.col("issues")).alias("code"),
        _result(risk_of(doc_issues), local_summary(doc_issues), doc_issues).alias("doc"),
    )
    # a file that is given twice has two equal rows
    variants = variants.groupBy("diff_hash").agg(F.first("code").alias("code"), F.first("doc").alias("doc"))
    none = F.lit(None).cast(RESULT)
    if verdicts is None:
        variants = variants.withColumns({"called": F.lit(False), "merged": none})
    else:
        joined = variants.join(latest_verdicts(verdicts), "diff_hash", "left")
        issues = merge_issues(F.col("code.issues"), F.col("verdict.issues"))
        variants = joined.select(
            "diff_hash", "code", "doc",
            F.col("verdict").isNotNull().alias("called"),
            F.when(
                F.col("verdict.issues").isNotNull(),
                _result(risk_of(issues), F.col("verdict.summary"), issues),
            ).alias("merged"),
        )
    variants = variants.withColumn("cached", none)
    if hits is None:
        return variants
    return variants.unionByName(hits.select(
        "diff_hash", none.alias("code"), none.alias("doc"), F.lit(False).alias("called"),
        none.alias("merged"), "cached",
    ))


def _own_result(groups: DataFrame, results: DataFrame) -> DataFrame:
    """Attach the result each group would get on its own, and whether it may be stored."""
    joined = join_unique(groups, results, "diff_hash")
    local = F.when(F.col("is_doc"), F.col("doc")).otherwise(F.col("code"))
    way = F.when(F.col("cached").isNotNull(), F.lit("cached")).otherwise(
        route(F.col("is_doc"), local["overall_risk"], F.col("path_risk"))
    )
    return (
        joined.withColumn("own_route", way)
        .withColumn("_reviewed", F.col("own_route") == REVIEW)
        .withColumn("_merged", F.col("_reviewed") & F.col("merged").isNotNull())
        .withColumn(
            "own",
            F.when(F.col("cached").isNotNull(), F.col("cached"))
            .when(F.col("_merged"), F.col("merged"))
            .otherwise(local),
        )
        .withColumn("own_called", F.col("_reviewed") & F.col("called"))
        .withColumn(
            "_storable",
            F.col("cached").isNull()
            & (F.col("own.overall_risk") != "LOW")
            & (~F.col("_reviewed") | F.col("_merged")),
        )
        .drop("code", "doc", "merged", "cached", "called", "_reviewed", "_merged")
    )


def _attributed(result: Column, path: Column) -> Column:
    """The result with ``path`` as file of the issues that name none."""
    issues = F.transform(result["issues"], lambda i: F.struct(*[
        (F.coalesce(i[n], path) if n == "file" else i[n]).alias(n) for n in ISSUE.names
    ]))
    return _result(result["overall_risk"], result["summary"], issues)


def check_changes(
    files: DataFrame,
    cache: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    run_keys: Sequence[str] = RUN_KEYS,
    rules: Sequence[Rule] = DEFAULT_RULES,
    max_chars: int | None = None,
) -> ChangeCheck:
    """Check changed files (run keys, ``file_idx``, ``file_path``, ``diff``).

    Within a run, files are taken in ``file_idx`` order: once a diff has a
    storable result (not LOW, and not a failed review), later files with the same
    diff reuse it as a cache hit, exactly as if they had been processed one by one.
    ``cache`` is what ``load_cache`` returns, ``verdicts`` a table of
    ``(diff_hash, response)``.
    """
    runs = list(run_keys)
    prepared = prepare_files(files, max_chars)
    narrow = written_once(
        prepared.select(*runs, "file_idx", "file_path", "diff_hash", "is_doc", "path_risk")
    )
    results = scan_distinct(prepared, narrow, [*runs, "file_idx"], rules, cache, verdicts)

    group = [*runs, "diff_hash", "is_doc", "path_risk"]
    groups = narrow.groupBy(*group).agg(
        F.min(F.struct("file_idx", "file_path")).alias("_first")
    )
    # a run has at most six groups per diff (documentation or not, three path risks)
    same_diff = Window.partitionBy(*runs, "diff_hash")
    storing = F.when(F.col("_storable"), F.col("_first"))
    decided = _own_result(groups, results).withColumns({
        "_stored_by": F.min(storing).over(same_diff),
        "_stored": F.min_by("own", storing).over(same_diff),
    }).drop("_first", "_storable")

    per_file = join_unique(narrow, decided, group)
    reused = F.coalesce(F.col("file_idx") > F.col("_stored_by.file_idx"), F.lit(False))
    file_results = (
        per_file.withColumn("_reused", reused)
        .withColumn(
            "_r",
            F.when(
                F.col("_reused"), _attributed(F.col("_stored"), F.col("_stored_by.file_path"))
            ).otherwise(_attributed(F.col("own"), F.col("file_path"))),
        )
        .select(
            *runs, "file_idx", "file_path", "diff_hash",
            F.when(F.col("_reused"), F.lit("cached")).otherwise(F.col("own_route")).alias("route"),
            (F.col("own_called") & ~F.col("_reused")).alias("called"),
            (F.col("file_idx") == F.col("_stored_by.file_idx")).alias("_stores"),
            "_r.*",
        )
    )
    file_results = written_once(file_results)
    visible = file_results.drop("_stores")
    stored = (
        file_results.where("_stores")
        .groupBy("diff_hash")
        .agg(F.min_by(F.struct("overall_risk", "summary", "issues"), F.struct(*runs)).alias("_r"))
        .select("diff_hash", "_r.*")
    )
    return ChangeCheck(
        file_results=visible,
        run_results=_run_results(files, visible, runs),
        issues=number_issues(visible, runs, written=True),
        new_cache_entries=cache_entries(stored, ruleset_version(tuple(rules))),
    )


def _run_results(files: DataFrame, file_results: DataFrame, runs: list[str]) -> DataFrame:
    """Run summary plus statistics; runs of skipped files only are reported too."""
    scanned = files.groupBy(*runs).agg(
        F.count_if(~should_skip(F.col("file_path"))).alias("files_scanned")
    )
    stats = file_results.groupBy(*runs).agg(
        F.count_if("called").alias("model_calls"),
        F.count_if(F.col("route") == "cached").alias("cache_hits"),
    )
    joined = scanned.join(run_summary(file_results, runs), runs, "left").join(stats, runs, "left")
    zero = {c: 0 for c in (
        "n_files", "n_issues", "n_high", "n_medium", "model_calls", "cache_hits",
    )}
    empty = F.when(F.col("files_scanned") == 0, F.lit(NOTHING_TO_SCAN)).otherwise(
        F.lit("No privacy issues found across 0 scanned file(s).")
    )
    return joined.fillna(zero).withColumns({
        "overall_risk": F.coalesce("overall_risk", F.lit("LOW")),
        "summary": F.coalesce("summary", empty),
        "blocked": F.coalesce("blocked", F.lit(False)),
    })
