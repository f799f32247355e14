"""All registered queries with their SQL twins.

Every query runs over its whole tables and whole texts; ``diff_hash_truncate``
shows the cut that a caller may ask for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift import operators as O
from veilsift import sources as S
from veilsift.functions import (
    added_lines, added_text, base_name, content_hash, cut_diff, html_escape, is_doc_file,
    path_risk, shannon_entropy, should_skip,
)
from veilsift.plans import (
    check_changes, check_packages, review_requests, score_requests, scoring_requests,
)
from veilsift.rules import DEFAULT_RULES, MAX_DIFF_CHARS, ruleset_version
from veilsift.operators.joins import join_unique
from veilsift.operators.packages import clause_rows
from veilsift.operators.scan import rule_field
from veilsift.session import scratch_root, written_once
from veilsift.sources.scan_cache import latest_entries
from veilsift.streaming import issues_per_window, once_per_diff, scan_stream, start_cached_scan

from . import oracle as Q
from . import views as V
from .views import quote

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIFFS = f"file_diffs AS ({V.FILE_DIFFS_SQL})"
COPIES = f"copied_diffs AS ({V.COPIED_DIFFS_SQL})"
ISSUES = f"{DIFFS},\n{Q.issue_ctes('file_diffs', 'file_idx')}"
RUN = "CAST(file_idx % 20 AS INTEGER) AS repo_id, CAST(file_idx % 100 AS INTEGER) AS commit_no"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- files ---------------------------------------------------------------------

@query(f"""WITH {DIFFS}
SELECT file_idx, {Q.should_skip('file_path')} AS skipped, {Q.base_name('file_path')} AS base_name
FROM file_diffs""")
def triage_files(spark, sf_dir):
    path = F.col("file_path")
    return V.file_diffs(spark, sf_dir).select(
        "file_idx", should_skip(path).alias("skipped"), base_name(path).alias("base_name")
    )


@query(f"WITH {DIFFS} SELECT file_idx, {Q.is_doc('file_path')} AS is_doc FROM file_diffs")
def doc_files(spark, sf_dir):
    return V.file_diffs(spark, sf_dir).select(
        "file_idx", is_doc_file(F.col("file_path")).alias("is_doc")
    )


@query(f"WITH {DIFFS} SELECT file_idx, {Q.path_risk('file_path')} AS path_risk FROM file_diffs")
def path_risks(spark, sf_dir):
    return V.file_diffs(spark, sf_dir).select(
        "file_idx", path_risk(F.col("file_path")).alias("path_risk")
    )


@query(f"""WITH {DIFFS},
kept AS (SELECT * FROM file_diffs WHERE change_type IN ('A', 'C', 'M', 'R', 'T'))
SELECT repo_id, file_idx, change_type, is_staged FROM kept
WHERE is_staged OR repo_id NOT IN (SELECT repo_id FROM kept WHERE is_staged)""")
def changed_files(spark, sf_dir):
    return S.changed_files(V.file_diffs(spark, sf_dir)).select(
        "repo_id", "file_idx", "change_type", "is_staged"
    )


HEAD_SQL = "CASE WHEN file_idx % 3 <> 0 THEN '+head of ' || file_path END"


@query(f"""WITH {DIFFS},
picked AS (SELECT file_idx, CASE WHEN is_staged THEN diff ELSE coalesce({HEAD_SQL}, '') END AS diff
  FROM file_diffs)
SELECT file_idx, sha256(diff) AS diff_hash, length(diff) AS n_chars FROM picked""")
def picked_diffs(spark, sf_dir):
    """The staged diff; the diff against the last commit where that is blank or missing."""
    files = V.file_diffs(spark, sf_dir)
    path, key = F.col("file_path"), F.col("file_idx")
    both = files.select(
        "file_idx",
        F.when(F.col("is_staged"), F.col("diff")).when(key % 2 == 0, F.lit(" \n\t")).alias("staged"),
        F.when(key % 3 != 0, F.concat(F.lit("+head of "), path)).alias("head"),
    )
    diff = F.col("diff")
    return S.pick_diff(both, "staged", "head").select(
        "file_idx", content_hash(diff).alias("diff_hash"), F.length(diff).alias("n_chars")
    )


@query(f"""WITH {DIFFS}
SELECT file_idx, sha256(diff) AS diff_hash FROM file_diffs
WHERE file_idx % 4 <> 0 AND NOT {Q.should_skip('file_path')}""")
def blank_diffs(spark, sf_dir):
    """Blank diffs, of spaces of any kind, and null ones take no part."""
    key = F.col("file_idx")
    blank = F.when(key % 8 == 0, F.lit(" \n\t\u00a0\u2003\r\n"))
    files = V.file_diffs(spark, sf_dir).withColumn(
        "diff", F.when(key % 4 == 0, blank).otherwise(F.col("diff"))
    )
    return S.prepare_files(files).select("file_idx", "diff_hash")


@query(f"""WITH {DIFFS},
cut AS (SELECT file_idx, {Q.cut('diff')} AS diff FROM file_diffs)
SELECT file_idx, sha256(diff) AS diff_hash, length(diff) AS n_chars FROM cut""")
def diff_hash_truncate(spark, sf_dir):
    diff = cut_diff(F.col("diff"), MAX_DIFF_CHARS)
    return V.file_diffs(spark, sf_dir).select(
        "file_idx", content_hash(diff).alias("diff_hash"), F.length(diff).alias("n_chars")
    )


@query(f"""WITH {DIFFS}, {Q.added_ctes('file_diffs')}
SELECT file_idx, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM added""")
def added_line_rows(spark, sf_dir):
    return V.file_diffs(spark, sf_dir).select(
        "file_idx", F.posexplode(added_lines(F.col("diff"))).alias("pos", "line")
    ).select("file_idx", (F.col("pos") + 1).alias("line_no"), "line")


@query(f"""WITH {DIFFS}, {Q.added_ctes('file_diffs')}
SELECT file_idx, len(lines) AS n_lines, sha256(added) AS added_hash FROM added""")
def added_texts(spark, sf_dir):
    diff = F.col("diff")
    return V.file_diffs(spark, sf_dir).select(
        "file_idx", F.size(added_lines(diff)).alias("n_lines"),
        content_hash(added_text(diff)).alias("added_hash"),
    )


@query(f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, round({Q.entropy('line')}, 6) AS entropy FROM lines""")
def line_entropy(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    ).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"),
        F.round(shannon_entropy(F.col("line")), 6).alias("entropy"),
    )


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def html_escaped(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(
        "page_id", html_escape(F.col("html")).alias("escaped")
    )


# -- scan ----------------------------------------------------------------------

@query(f"""WITH {ISSUES}
SELECT rule_id, count(*) AS n_files FROM hits GROUP BY rule_id""")
def rule_hits(spark, sf_dir):
    return O.rule_hits(V.file_diffs(spark, sf_dir)).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n_files")
    )


@query(f"""WITH {ISSUES}
SELECT file_idx, file_path AS file, rule_idx, rule_id, hint AS line_hint, severity, issue, fix,
       regulation FROM issues""")
def issues(spark, sf_dir):
    rows = O.issue_rows(O.scan_rules(V.file_diffs(spark, sf_dir)), "file_idx")
    return rows.drop("issue_pos")


@query(f"""WITH {ISSUES}
SELECT file_idx, is_doc, overall_risk, summary, n_issues FROM file_results""")
def file_risk(spark, sf_dir):
    return O.scan_rules(V.file_diffs(spark, sf_dir)).select(
        "file_idx", is_doc_file(F.col("file_path")).alias("is_doc"), "overall_risk", "summary",
        F.size("issues").alias("n_issues"),
    )


RUN_SUMMARY_SQL = f"""WITH {ISSUES},
runs AS (
  SELECT {RUN}, count(*) AS n_files, CAST(sum(n_issues) AS BIGINT) AS n_issues,
         CAST(sum(n_high) AS BIGINT) AS n_high, CAST(sum(n_medium) AS BIGINT) AS n_medium FROM file_results GROUP BY ALL)
SELECT repo_id, commit_no, n_files, n_issues, n_high, n_medium,
       CASE WHEN n_high > 0 THEN 'HIGH' WHEN n_medium > 0 THEN 'MEDIUM' ELSE 'LOW' END
         AS overall_risk,
       CASE WHEN n_issues = 0
         THEN 'No privacy issues found across ' || n_files || ' scanned file(s).'
         ELSE 'Found ' || n_issues || ' issue(s) across ' || n_files || ' file(s) — ' || n_high
           || ' high, ' || n_medium || ' medium.' END AS summary,
       n_high > 0 AS blocked FROM runs"""


@query(RUN_SUMMARY_SQL)
def run_summary(spark, sf_dir):
    return O.run_summary(O.scan_rules(V.file_diffs(spark, sf_dir)))


@query(f"""WITH {ISSUES}
SELECT severity, category, count(*) AS n_issues FROM issues GROUP BY ALL""")
def severity_counts(spark, sf_dir):
    rows = O.issue_rows(O.scan_rules(V.file_diffs(spark, sf_dir)))
    return rows.groupBy(
        "severity", rule_field(DEFAULT_RULES, "category", F.col("rule_idx")).alias("category")
    ).agg(F.count(F.lit(1)).alias("n_issues"))


@query(f"""WITH {ISSUES}
SELECT {RUN}, row_number() OVER (
         PARTITION BY file_idx % 20, file_idx % 100 ORDER BY file_idx, rule_idx) AS issue_no,
       file_idx, file_path AS file, rule_id, severity, hint AS line_hint, issue, fix, regulation
FROM issues""")
def issue_numbering(spark, sf_dir):
    return O.number_issues(O.scan_rules(V.file_diffs(spark, sf_dir)))


@query(f"""WITH {ISSUES}
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY file_idx, rule_idx) AS issue_no,
       file_idx, rule_id FROM issues JOIN file_diffs USING (file_idx)""")
def issue_numbering_by_language(spark, sf_dir):
    """Few, large runs: most files share one language."""
    numbered = O.number_issues(O.scan_rules(V.file_diffs(spark, sf_dir)), run_keys=["lang"])
    return numbered.select("lang", "issue_no", "file_idx", "rule_id")


# -- routing and verdicts ------------------------------------------------------

def _routed(spark, sf_dir) -> DataFrame:
    files = V.file_diffs(spark, sf_dir)
    path = F.col("file_path")
    return (
        O.scan_rules(files.withColumn("is_doc", is_doc_file(path)), doc_col="is_doc")
        .withColumn("route", O.route(F.col("is_doc"), F.col("overall_risk"), path_risk(path)))
        .withColumn("diff_hash", content_hash(F.col("diff")))
    )


@query(f"WITH {ISSUES} SELECT file_idx, {Q.ROUTE} AS route FROM file_results")
def route_decision(spark, sf_dir):
    return _routed(spark, sf_dir).select("file_idx", "route")


VERDICT_SQL = f"""reviewed AS (
  SELECT *, {Q.ROUTE} AS route, {Q.ROUTE} = 'review' AND file_idx % 3 <> 2 AS merged
  FROM file_results),
asked AS (
  SELECT v.file_idx, r.issue, 'MEDIUM' AS severity, 1 AS item FROM reviewed v
  JOIN rules r ON r.rule_idx = (v.file_idx % 50) % 43 WHERE v.merged
  UNION ALL
  SELECT file_idx, {quote(V.NEW_ISSUE)}, CASE WHEN file_idx % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END,
         2 FROM reviewed WHERE merged),
all_issues AS (
  SELECT file_idx, issue, severity, 0 AS part, rule_idx AS ord, rule_id FROM issues
  UNION ALL
  SELECT a.file_idx, a.issue, a.severity, 1, a.item, NULL FROM asked a
  ANTI JOIN issues i ON i.file_idx = a.file_idx AND i.issue = a.issue)"""


def _merged(spark, sf_dir) -> DataFrame:
    files = V.file_diffs(spark, sf_dir)
    replies = V.verdicts(files, F.col("file_idx"))
    routed = _routed(spark, sf_dir).withColumn("diff_hash", content_hash(F.col("diff")))
    return O.merge_verdicts(routed.drop("diff"), replies)


@query(f"""WITH {ISSUES}, {VERDICT_SQL},
totals AS (SELECT file_idx, count(*) AS n, count(*) FILTER (WHERE severity = 'HIGH') AS h,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS m FROM all_issues GROUP BY 1)
SELECT v.file_idx, v.route, v.merged, coalesce(t.n, 0) AS n_issues,
       CASE WHEN t.h > 0 THEN 'HIGH' WHEN t.m > 0 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk,
       CASE WHEN v.merged THEN 'Reviewed case ' || (v.file_idx % 50) ELSE v.summary END AS summary
FROM reviewed v LEFT JOIN totals t USING (file_idx)""")
def merge_verdicts(spark, sf_dir):
    return _merged(spark, sf_dir).select(
        "file_idx", "route", "merged", F.size("issues").alias("n_issues"), "overall_risk",
        "summary",
    )


@query(f"""WITH {ISSUES}, {VERDICT_SQL}
SELECT file_idx, row_number() OVER (PARTITION BY file_idx ORDER BY part, ord) AS issue_no, rule_id,
       severity, issue FROM all_issues""")
def merged_issues(spark, sf_dir):
    return O.issue_rows(_merged(spark, sf_dir), "file_idx").select(
        "file_idx", (F.col("issue_pos") + 1).alias("issue_no"), "rule_id", "severity", "issue"
    )


@query(f"""WITH {DIFFS},
{Q.issue_ctes('file_diffs', 'file_idx', all_lines=True)}
SELECT file_idx, rule_id, hint AS line_hint, severity FROM issues""")
def issues_all_lines(spark, sf_dir):
    """Every matching line of every rule."""
    scanned = O.scan_rules(V.file_diffs(spark, sf_dir), all_lines=True)
    return O.issue_rows(scanned, "file_idx").select("file_idx", "rule_id", "line_hint", "severity")


# -- redaction -----------------------------------------------------------------

REDACT_SOURCES = {
    # name: (view, CTE, keys, text column)
    "diffs": (V.file_diffs, DIFFS, "file_diffs", "file_idx", "diff"),
    "documents": (None, None, "documents", "doc_id", "text"),
    "conversations": (
        lambda spark, sf_dir: V.with_planted(
            V.table(spark, sf_dir, "conversations"), "text", F.col("conv_id") + F.col("turn")),
        f"planted_turns AS ({V.with_planted_sql('conversations', 'text', 'conv_id + turn')})",
        "planted_turns", "conv_id, turn", "text",
    ),
    "pages": (
        lambda spark, sf_dir: V.with_planted(V.table(spark, sf_dir, "pages"), "html", F.col("page_id")),
        f"planted_pages AS ({V.with_planted_sql('pages', 'html', 'page_id')})",
        "planted_pages", "page_id", "html",
    ),
}


def _source(spark, sf_dir, name) -> tuple[DataFrame, list[str], str]:
    view, _, table, keys, text = REDACT_SOURCES[name]
    df = view(spark, sf_dir) if view else V.table(spark, sf_dir, table)
    key_list = [k.strip() for k in keys.split(",")]
    return df.select(*key_list, text), key_list, text


def _with(cte: str | None, rest: str) -> str:
    return f"WITH {cte},\n{rest}" if cte else f"WITH {rest}"


def _findings_query(name: str) -> Query:
    def run(spark, sf_dir):
        df, keys, text = _source(spark, sf_dir, name)
        found = O.find_sensitive(df, text)
        return found.select(*keys, F.posexplode("findings").alias("_p", "_f")).select(
            *keys, (F.col("_p") + 1).alias("pos"), "_f.*"
        )

    return run


def _redact_query(name: str) -> Query:
    def run(spark, sf_dir):
        df, keys, text = _source(spark, sf_dir, name)
        return O.redact(df, text).select(
            *keys, "redacted", "has_high", F.size("findings").alias("n_findings")
        )

    return run


for _name, (_, _cte, _table, _keys, _text) in REDACT_SOURCES.items():
    QUERIES[f"redaction_findings_{_name}"] = _findings_query(_name)
    ORACLES[f"redaction_findings_{_name}"] = _with(
        _cte,
        Q.finding_ctes(_table, _keys, _text)
        + f"\nSELECT {_keys}, pos, rule_id, category, severity, matched_text FROM findings",
    )
    QUERIES[f"redact_{_name}"] = _redact_query(_name)
    ORACLES[f"redact_{_name}"] = _with(
        _cte,
        Q.redact_ctes(_table, _keys, _text)
        + f"\nSELECT {_keys}, redacted, has_high, n_findings FROM redacted",
    )


@query(f"""WITH {DIFFS},
{Q.redact_ctes('file_diffs', 'file_idx', 'diff')},
modes(mode) AS (VALUES ('redact'), ('block'), ('warn'), ('off'))
SELECT file_idx, mode,
       CASE WHEN mode = 'off' THEN 'off' WHEN n_findings = 0 THEN 'clean'
            WHEN mode = 'warn' THEN 'warned' WHEN mode = 'block' AND has_high THEN 'blocked'
            ELSE 'redacted' END AS outbound_status,
       CASE WHEN mode = 'off' THEN '' ELSE rules_found END AS outbound_rules,
       CASE WHEN mode IN ('off', 'warn') THEN original
            WHEN mode = 'block' AND has_high THEN NULL ELSE redacted END AS outbound_text
FROM redacted, modes""")
def outbound_modes(spark, sf_dir):
    files = V.file_diffs(spark, sf_dir).select("file_idx", "diff")
    return O.outbound_by_mode(files, "diff").drop("diff")


PLANTED_DOCS = f"planted_docs AS ({V.with_planted_sql('documents', 'text', 'doc_id')})"


@query(f"""WITH {PLANTED_DOCS},
{Q.redact_ctes('planted_docs', 'doc_id', 'text', protect_safe_lines=True)}
SELECT doc_id, redacted, has_high, n_findings FROM redacted""")
def redact_protected(spark, sf_dir):
    """Lines with a safe reference stay as they are, even if a value found elsewhere is on them."""
    docs = V.with_planted(V.table(spark, sf_dir, "documents"), "text", F.col("doc_id"))
    return O.redact(docs, "text", protect_safe_lines=True).select(
        "doc_id", "redacted", "has_high", F.size("findings").alias("n_findings")
    )


@query(f"""WITH {PLANTED_DOCS},
{Q.finding_ctes('planted_docs', 'doc_id', 'text')}
SELECT category, severity, CAST(grouping(category, severity) AS BIGINT) AS level, count(*) AS n_findings,
       CAST(sum(length(matched_text)) AS BIGINT) AS n_chars
FROM findings GROUP BY CUBE (category, severity)""")
def findings_cube(spark, sf_dir):
    docs = V.with_planted(V.table(spark, sf_dir, "documents"), "text", F.col("doc_id"))
    return O.findings_cube(O.find_sensitive(docs, "text"))


REQUESTS = f"""{ISSUES},
reviewed AS (SELECT file_idx FROM file_results WHERE {Q.ROUTE} = 'review'),
wanted AS (SELECT d.* FROM file_diffs d JOIN reviewed USING (file_idx)),
{Q.redact_ctes('wanted', 'file_idx', 'diff', with_rules=False)},
requests AS (
  SELECT sha256(r.original) AS diff_hash,
       CASE WHEN n_findings = 0 THEN 'clean' ELSE 'redacted' END AS outbound_status,
       r.rules_found AS outbound_rules,
       'Review this diff for file "' || d.file_path || '":' || chr(10) || chr(10) || r.redacted
         AS request_text
  FROM redacted r JOIN file_diffs d USING (file_idx))"""


def _requests(spark, sf_dir) -> DataFrame:
    """Routes are written once without texts; the texts come from the files."""
    routed = written_once(_routed(spark, sf_dir).select("file_idx", "file_path", "diff_hash", "route"))
    files = V.file_diffs(spark, sf_dir).withColumn("diff_hash", content_hash(F.col("diff")))
    return review_requests(routed, files=files)


@query(f"WITH {REQUESTS} SELECT * FROM requests")
def review_request_texts(spark, sf_dir):
    return _requests(spark, sf_dir)


@query(f"""WITH {REQUESTS}, asked AS (
  SELECT *, contains(request_text, {quote(f'file "{V.DIRS[0]}')}) AS failed FROM requests)
SELECT diff_hash, CASE WHEN NOT failed THEN 'chars: ' || length(request_text) END AS response,
       CASE WHEN failed THEN 'ValueError: no reply' END AS error FROM asked""")
def scored_requests(spark, sf_dir):
    """A scorer that raises on some requests keeps its replies to all others."""
    hated = f'file "{V.DIRS[0]}'

    def scorer(texts):
        if texts.str.contains(hated, regex=False).any():
            raise ValueError("no reply")
        return texts.str.len().map("chars: {}".format)

    return score_requests(_requests(spark, sf_dir), scorer)


# -- cache and complete change check -------------------------------------------

KEPT_ISSUES = f"""{DIFFS},
kept_diffs AS (SELECT * FROM file_diffs
  WHERE NOT {Q.should_skip('file_path')}),
{Q.issue_ctes('kept_diffs', 'file_idx')}"""
CACHED = "lang = 'en' AND f.overall_risk <> 'LOW'"


def _english_cache(spark, sf_dir) -> DataFrame:
    """What earlier scans of the English files left in the cache."""
    english = V.file_diffs(spark, sf_dir).where(F.col("lang") == "en")
    scanned = O.scan_rules(S.prepare_files(english), doc_col="is_doc")
    return latest_entries(S.cache_entries(scanned))


@query(f"""WITH {KEPT_ISSUES}
SELECT f.file_idx, {CACHED} AS hit, CASE WHEN {CACHED} THEN f.overall_risk END AS cached_risk,
       CASE WHEN {CACHED} THEN f.n_issues ELSE 0 END AS cached_issues
FROM file_results f JOIN file_diffs d USING (file_idx)""")
def cache_hits(spark, sf_dir):
    files = S.prepare_files(V.file_diffs(spark, sf_dir)).select("file_idx", "diff_hash")
    cache = _english_cache(spark, sf_dir)
    return join_unique(files, cache, "diff_hash").select(
        "file_idx", F.col("result").isNotNull().alias("hit"),
        F.col("result.overall_risk").alias("cached_risk"),
        F.when(F.col("result").isNotNull(), F.size("result.issues")).otherwise(0)
        .alias("cached_issues"),
    )


@query(f"""WITH {KEPT_ISSUES}
SELECT f.file_idx, CASE WHEN {CACHED} THEN 'cached' ELSE {Q.ROUTE} END AS route,
       f.overall_risk, f.summary, f.n_issues
FROM file_results f JOIN file_diffs d USING (file_idx)""")
def cache_incremental(spark, sf_dir):
    """Half-warm cache: results equal a cold scan, only the routes tell them apart."""
    done = check_changes(V.file_diffs(spark, sf_dir), cache=_english_cache(spark, sf_dir))
    return done.file_results.select(
        "file_idx", "route", "overall_risk", "summary", F.size("issues").alias("n_issues")
    )


# The one-by-one semantics in SQL: own result per file, then the first storable
# file of the run with the same diff serves the later ones.
CHECK_SQL = f"""{COPIES},
kept_diffs AS (SELECT * FROM copied_diffs
  WHERE NOT {Q.should_skip('file_path')}),
{Q.issue_ctes('kept_diffs', 'file_idx')},
keyed AS (
  SELECT f.*, c.commit_no, sha256(c.diff) AS diff_hash, length(d.text) AS n, {Q.ROUTE} AS own_route
  FROM file_results f JOIN kept_diffs c USING (file_idx)
  JOIN documents d ON d.doc_id = f.file_idx),
replied AS (SELECT *, own_route = 'review' AND n % 3 <> 2 AS merged FROM keyed),
asked AS (
  SELECT v.file_idx, r.issue, 'MEDIUM' AS severity, 1 AS item FROM replied v
  JOIN rules r ON r.rule_idx = (v.n % 50) % 43 WHERE v.merged
  UNION ALL
  SELECT file_idx, {quote(V.NEW_ISSUE)}, CASE WHEN n % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END, 2
  FROM replied WHERE merged),
own_issues AS (
  SELECT file_idx, issue, severity, 0 AS part, rule_idx AS ord, rule_id, file_path AS file
  FROM issues
  UNION ALL
  SELECT a.file_idx, a.issue, a.severity, 1, a.item, NULL, 'm.ts' FROM asked a
  ANTI JOIN issues i ON i.file_idx = a.file_idx AND i.issue = a.issue),
own_totals AS (
  SELECT file_idx, count(*) AS n_all, count(*) FILTER (WHERE severity = 'HIGH') AS n_h,
         count(*) FILTER (WHERE severity = 'MEDIUM') AS n_m FROM own_issues GROUP BY 1),
own AS (
  SELECT v.*, coalesce(t.n_all, 0) AS n_all, coalesce(t.n_h, 0) AS n_h, coalesce(t.n_m, 0) AS n_m,
         CASE WHEN t.n_h > 0 THEN 'HIGH' WHEN t.n_m > 0 THEN 'MEDIUM' ELSE 'LOW' END AS own_risk,
         CASE WHEN merged THEN 'Reviewed case ' || (n % 50) ELSE v.summary END AS own_summary
  FROM replied v LEFT JOIN own_totals t USING (file_idx)),
stored AS (
  SELECT commit_no, diff_hash, min(file_idx) AS first_idx FROM own
  WHERE own_risk <> 'LOW' AND (own_route <> 'review' OR merged) GROUP BY ALL),
final AS (
  SELECT o.commit_no, o.file_idx, o.diff_hash, o.file_path,
         coalesce(o.file_idx > s.first_idx, false) AS reused,
         CASE WHEN coalesce(o.file_idx > s.first_idx, false) THEN s.first_idx ELSE o.file_idx END
           AS result_of
  FROM own o LEFT JOIN stored s USING (commit_no, diff_hash)),
checked AS (
  SELECT f.*, CASE WHEN f.reused THEN 'cached' ELSE m.own_route END AS route,
         CASE WHEN f.reused THEN false ELSE m.own_route = 'review' AND m.merged END AS called,
         r.own_risk AS overall_risk, r.own_summary AS summary, r.n_all, r.n_h, r.n_m
  FROM final f JOIN own m ON m.file_idx = f.file_idx JOIN own r ON r.file_idx = f.result_of)"""


def _check_copies(spark, sf_dir):
    return check_changes(
        V.copied_diffs(spark, sf_dir), verdicts=_copy_verdicts(spark, sf_dir)
    )


def _copy_verdicts(spark, sf_dir) -> DataFrame:
    return V.verdicts(V.copied_diffs(spark, sf_dir), F.col("text_chars"))


@query(f"""WITH {CHECK_SQL}
SELECT file_idx, diff_hash, route, called, overall_risk, summary, n_all AS n_issues FROM checked""")
def check_files(spark, sf_dir):
    """Complete check with verdicts and reuse of copied diffs within a run."""
    return _check_copies(spark, sf_dir).file_results.select(
        "file_idx", "diff_hash", "route", "called", "overall_risk", "summary",
        F.size("issues").alias("n_issues"),
    )


@query(f"""WITH {CHECK_SQL}
SELECT commit_no, row_number() OVER (
         PARTITION BY commit_no ORDER BY c.file_idx, i.part, i.ord) AS issue_no,
       c.file_idx, i.file, i.rule_id, i.severity, i.issue
FROM checked c JOIN own_issues i ON i.file_idx = c.result_of""")
def check_issues(spark, sf_dir):
    return _check_copies(spark, sf_dir).issues.select(
        "commit_no", "issue_no", "file_idx", "file", "rule_id", "severity", "issue"
    )


@query(f"""WITH {CHECK_SQL},
seen AS (SELECT commit_no, count(*) FILTER (WHERE NOT {Q.should_skip('file_path')})
  AS files_scanned FROM copied_diffs GROUP BY 1),
runs AS (SELECT commit_no, count(*) AS n_files, CAST(sum(n_all) AS BIGINT) AS n_issues,
  CAST(sum(n_h) AS BIGINT) AS n_high, CAST(sum(n_m) AS BIGINT) AS n_medium,
  count(*) FILTER (WHERE called) AS model_calls,
  count(*) FILTER (WHERE route = 'cached') AS cache_hits FROM checked GROUP BY 1)
SELECT *, CASE WHEN n_high > 0 THEN 'HIGH' WHEN n_medium > 0 THEN 'MEDIUM' ELSE 'LOW' END
         AS overall_risk,
       CASE WHEN n_issues = 0
         THEN 'No privacy issues found across ' || n_files || ' scanned file(s).'
         ELSE 'Found ' || n_issues || ' issue(s) across ' || n_files || ' file(s) — ' || n_high
           || ' high, ' || n_medium || ' medium.' END AS summary,
       n_high > 0 AS blocked
FROM seen JOIN runs USING (commit_no)""")
def check_runs(spark, sf_dir):
    return _check_copies(spark, sf_dir).run_results.drop("repo_id")


@query(f"""WITH {CHECK_SQL}
SELECT diff_hash, overall_risk, summary, n_all AS n_issues FROM checked c
WHERE NOT reused AND EXISTS (SELECT 1 FROM stored s WHERE s.first_idx = c.file_idx)
QUALIFY row_number() OVER (PARTITION BY diff_hash ORDER BY commit_no) = 1""")
def check_cache_entries(spark, sf_dir):
    return _check_copies(spark, sf_dir).new_cache_entries.select(
        "diff_hash", "result.overall_risk", "result.summary",
        F.size("result.issues").alias("n_issues"),
    )


@query(f"""WITH {KEPT_ISSUES},
routed AS (SELECT f.*, CASE WHEN {CACHED} THEN 'cached' ELSE {Q.ROUTE} END AS route
  FROM file_results f JOIN file_diffs d USING (file_idx))
SELECT {RUN}, count(*) AS n_files,
       count(*) FILTER (WHERE route = 'review' AND file_idx % 3 <> 2) AS model_calls,
       count(*) FILTER (WHERE route = 'cached') AS cache_hits FROM routed GROUP BY ALL""")
def run_stats(spark, sf_dir):
    """Half-warm cache, and replies to two thirds of the diffs."""
    files = V.file_diffs(spark, sf_dir)
    done = check_changes(files, _english_cache(spark, sf_dir), V.verdicts(files, F.col("file_idx")))
    return O.run_stats(done.file_results)


def _stored(spark, entries, **version) -> DataFrame:
    """Entries written to a cache table and read back."""
    path = f"{_scratch(spark)}/cache"
    S.append_cache(entries, path, "first")
    return S.load_cache(spark, path, **version)


STORABLE = f"{CACHED} AND {Q.ROUTE} <> 'review'"


@query(f"""WITH {KEPT_ISSUES}
SELECT f.file_idx, CASE WHEN {STORABLE} THEN 'cached' ELSE {Q.ROUTE} END AS route, f.overall_risk, f.n_issues
FROM file_results f JOIN file_diffs d USING (file_idx)""")
def cache_roundtrip(spark, sf_dir):
    """A check of the English files stores entries; the next check of all files reads them."""
    files = V.file_diffs(spark, sf_dir)
    first = check_changes(files.where(F.col("lang") == "en"))
    done = check_changes(files, cache=_stored(spark, first.new_cache_entries))
    return done.file_results.select("file_idx", "route", "overall_risk", F.size("issues").alias("n_issues"))


@query(f"""WITH {KEPT_ISSUES}
SELECT sha256(d.diff) AS diff_hash, f.overall_risk, f.n_issues, CAST(1 AS BIGINT) AS n_rows
FROM file_results f JOIN file_diffs d USING (file_idx) WHERE f.overall_risk <> 'LOW'""")
def cache_compacted(spark, sf_dir):
    """Entries appended by one job, by a second one and by its retry, then compacted in place."""
    files = V.file_diffs(spark, sf_dir)
    path = f"{_scratch(spark)}/cache"
    for part, rows in (("first", files.where(F.col("lang") == "en")), ("second", files), ("second", files)):
        scanned = O.scan_rules(S.prepare_files(rows), doc_col="is_doc")
        S.append_cache(S.cache_entries(scanned), path, part)
    S.compact_in_place(spark, path)
    rows = spark.read.parquet(path).groupBy("diff_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    return join_unique(S.load_cache(spark, path), rows, "diff_hash").select(
        "diff_hash", "result.overall_risk", F.size("result.issues").alias("n_issues"), "n_rows"
    )


OWN_RULES = DEFAULT_RULES[:20]


@query(f"""WITH {KEPT_ISSUES},
own AS (
  SELECT a.file_idx, a.diff, a.is_doc, a.path_risk, count(i.rule_idx) AS n_issues,
    CASE WHEN count(*) FILTER (WHERE i.severity = 'HIGH') > 0 THEN 'HIGH'
         WHEN count(*) FILTER (WHERE i.severity = 'MEDIUM') > 0 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk
  FROM added a LEFT JOIN issues i ON i.file_idx = a.file_idx AND i.rule_idx < {len(OWN_RULES)} GROUP BY ALL)
SELECT sha256(diff) AS diff_hash, overall_risk, n_issues, CAST(0 AS BIGINT) AS n_default FROM own
WHERE overall_risk <> 'LOW' AND {Q.ROUTE} <> 'review'""")
def cache_own_rules(spark, sf_dir):
    """Entries of a check with own rules are found under these rules' version, not the default's."""
    done = check_changes(V.file_diffs(spark, sf_dir), rules=OWN_RULES)
    path = f"{_scratch(spark)}/cache"
    S.append_cache(done.new_cache_entries, path, "own")
    own = S.load_cache(spark, path, version=ruleset_version(tuple(OWN_RULES)))
    return own.select(
        "diff_hash", "result.overall_risk", F.size("result.issues").cast("long").alias("n_issues"),
        F.lit(S.load_cache(spark, path).count()).cast("long").alias("n_default"),
    )


@query(f"""WITH {KEPT_ISSUES}
SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after
FROM file_results f JOIN file_diffs d USING (file_idx) WHERE {CACHED}""")
def cache_cleared(spark, sf_dir):
    """A stored cache, before and after it is cleared."""
    english = V.file_diffs(spark, sf_dir).where(F.col("lang") == "en")
    entries = S.cache_entries(O.scan_rules(S.prepare_files(english), doc_col="is_doc"))
    path = f"{_scratch(spark)}/cache"
    S.append_cache(entries, path, "first")
    before = S.load_cache(spark, path).count()
    S.clear_cache(spark, path)
    return S.load_cache(spark, path).agg(
        F.lit(before).cast("long").alias("n_before"), F.count("*").alias("n_after")
    )


# -- dependencies --------------------------------------------------------------

DEPS = f"dependencies AS ({V.DEPENDENCIES_SQL}), merged AS ({V.MERGED_SQL})"
PKG = f"packages AS ({V.PACKAGES_SQL})"
REF = (
    f"{PKG}, reference AS (SELECT n AS ordinal, 'Group ' || (n // 10) AS category, "
    "'pkg' || n AS name, CASE WHEN n % 10 = 9 THEN 'Deprecated' END AS status, "
    "about AS description, 'https://npm.acme.net/pkg' || n AS npm_url, "
    "CASE WHEN n % 2 = 0 THEN 'https://sec.acme.net/' || n END AS security_url, "
    f"CASE WHEN n % 3 = 0 THEN {V.policy_url_sql('n')} END AS privacy_url, "
    "'https://git.acme.net/' || n AS github_url, "
    "CASE WHEN n % 10 = 9 THEN 'Unmaintained, look for `another`' END AS note "
    "FROM packages WHERE n % 8 <> 7)"
)
JUDGED = (
    "first_judged AS (SELECT n, about, 'pkg' || n AS name, '1.0.0' AS version, "
    "['SAFE', 'CAUTION', 'HIGH_RISK'][n % 3 + 1] AS score, 'About ' || about AS reason, "
    "CASE WHEN n % 3 = 2 THEN 'alt-pkg' || n END AS alternative, "
    "CASE WHEN n % 2 = 0 THEN 'GDPR Article 6' END AS regulation, "
    f"CASE WHEN n % 4 = 0 THEN {V.policy_url_sql('n')} END AS privacy_policy_url "
    "FROM packages WHERE n % 7 <> 6), "
    "judged AS (SELECT * EXCLUDE (n, about) FROM first_judged UNION ALL "
    "SELECT * EXCLUDE (n, about) REPLACE ('1.3.0' AS version, 'HIGH_RISK' AS score, "
    "'Version of ' || about AS reason) FROM first_judged WHERE n % 5 = 0)"
)
SCORED = f"""{DEPS}, {REF}, {JUDGED},
scored AS (
  SELECT m.manifest_id, m.name, m.version, m.is_dev, coalesce(j.score, 'UNSCORED') AS score,
         j.reason, j.alternative, j.regulation,
         coalesce(r.privacy_url, j.privacy_policy_url) AS privacy_policy_url
  FROM merged m LEFT JOIN reference r USING (name) LEFT JOIN judged j USING (name)
  QUALIFY row_number() OVER (PARTITION BY m.manifest_id, m.name ORDER BY
    coalesce(j.version = m.version, false) DESC,
    list_position(['HIGH_RISK', 'CAUTION', 'SAFE'], j.score), j.version) = 1)"""


@query(f"WITH {DEPS} SELECT manifest_id, name, version, is_dev FROM merged")
def dependency_list(spark, sf_dir):
    return S.manifest_dependencies(V.manifests(spark, sf_dir)).drop("ordinal")


@query(f"""WITH {DEPS}
SELECT manifest_id, count(*) AS n_dependencies,
       string_agg(name || '@' || version, chr(10) ORDER BY dev_only, name) AS dependency_list
FROM merged GROUP BY manifest_id""")
def dependency_prompts(spark, sf_dir):
    return S.dependency_lists(V.manifests(spark, sf_dir))


@query(f"WITH {REF} SELECT * FROM reference")
def package_reference(spark, sf_dir):
    return S.parse_reference(V.reference_documents(spark, sf_dir))


@query(f"WITH {PKG}, {JUDGED} SELECT * FROM judged")
def package_verdicts(spark, sf_dir):
    return O.parse_package_verdicts(V.package_replies(spark, sf_dir))


@query(f"""WITH {DEPS}, {REF}
SELECT m.manifest_id, m.name, m.version, r.category, r.status, r.privacy_url, r.security_url
FROM merged m LEFT JOIN reference r USING (name)""")
def dependency_reference(spark, sf_dir):
    deps = S.manifest_dependencies(V.manifests(spark, sf_dir))
    reference = S.unique_reference(S.parse_reference(V.reference_documents(spark, sf_dir)))
    return O.attach_reference(deps, reference).drop("ordinal", "is_dev")


ENTRY_SQL = """'### ' || ordinal || '. **' || name || '**' || coalesce(' (' || status || ')', '')
  || coalesce(chr(10) || description, '') || coalesce(chr(10) || '- **npm**: ' || npm_url, '')
  || coalesce(chr(10) || '- **Security Policy**: ' || security_url, '')
  || coalesce(chr(10) || '- **Privacy Policy**: ' || privacy_url, '')
  || coalesce(chr(10) || '- **GitHub**: ' || github_url, '')
  || coalesce(chr(10) || '- **Note**: ' || note, '')"""


@query(f"""WITH {DEPS}, {REF},
lists AS (
  SELECT manifest_id, string_agg(name || '@' || version, chr(10) ORDER BY dev_only, name) AS dependency_list
  FROM merged GROUP BY manifest_id),
entries AS (
  SELECT manifest_id, string_agg({ENTRY_SQL}, chr(10) || chr(10) ORDER BY ordinal) AS entries
  FROM merged JOIN reference USING (name) GROUP BY manifest_id)
SELECT manifest_id,
       CASE WHEN entries IS NULL THEN 'Package reference: none.'
            ELSE 'Package reference:' || chr(10) || chr(10) || entries END || chr(10) || chr(10)
         || 'Score these npm packages for privacy risk:' || chr(10) || chr(10) || dependency_list AS request_text
FROM lists LEFT JOIN entries USING (manifest_id)""")
def package_requests(spark, sf_dir):
    """Each manifest's request has the reference entries of its own packages."""
    reference = S.parse_reference(V.reference_documents(spark, sf_dir))
    return scoring_requests(V.manifests(spark, sf_dir), reference)


def _package_check(spark, sf_dir):
    return check_packages(
        V.manifests(spark, sf_dir),
        S.parse_reference(V.reference_documents(spark, sf_dir)),
        O.parse_package_verdicts(V.package_replies(spark, sf_dir)),
        V.policy_reports(spark, sf_dir),
    )


@query(f"WITH {SCORED} SELECT * FROM scored")
def package_scores(spark, sf_dir):
    return _package_check(spark, sf_dir).results.drop("ordinal", "privacy_report")


@query(f"""WITH {SCORED}
SELECT manifest_id, count(*) FILTER (WHERE score = 'HIGH_RISK') AS n_high_risk,
       count(*) FILTER (WHERE score = 'CAUTION') AS n_caution,
       count(*) FILTER (WHERE score = 'SAFE') AS n_safe,
       count(*) FILTER (WHERE score = 'UNSCORED') AS n_unscored
FROM scored GROUP BY manifest_id""")
def score_counts(spark, sf_dir):
    return _package_check(spark, sf_dir).counts


@query(f"""WITH {SCORED}
SELECT manifest_id, name, version, score,
       list_position(['HIGH_RISK', 'CAUTION', 'SAFE', 'UNSCORED'], score) - 1 AS score_rank
FROM scored""")
def dependency_report(spark, sf_dir):
    report = O.dependency_report(_package_check(spark, sf_dir).results)
    return report.select("manifest_id", "name", "version", "score", "score_rank")


# the report content per package, for packages whose report is readable
REPORTS = f"""bodies AS (
  SELECT n, {V.policy_url_sql('n')} AS url, n % 5 AS kind, about,
         CAST(size + CASE WHEN n % 2 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score,
         CASE WHEN n % 4 <> 3 THEN ['A', 'B', 'C'][n % 3 + 1] END AS grade, n % 9 AS n_clauses
  FROM packages),
envelopes AS (
  SELECT n, url, kind IN (0, 1) AS ok, CASE WHEN kind = 2 THEN 500 WHEN kind <> 4 THEN 200 END
           AS status_code,
         CASE WHEN kind = 2 AND n % 2 = 0 THEN 'limit reached'
              WHEN kind = 2 THEN 'Policy report service returned HTTP 500'
              WHEN kind = 3 THEN 'Failed to parse policy report response'
              WHEN kind = 4 AND n % 2 = 0 THEN 'Policy report request timed out after 240 seconds'
              WHEN kind = 4 THEN 'Policy report request failed: reset' END AS error,
         CASE WHEN kind = 2 AND n % 2 = 0 THEN '{{"error":"limit reached"}}'
              WHEN kind = 2 THEN '{{"summary":"x"}}' WHEN kind = 3 THEN '{{"grade": "A"' END
           AS raw_response,
         CASE WHEN kind IN (0, 1) THEN grade END AS grade,
         CASE WHEN kind IN (0, 1) THEN score END AS score,
         CASE WHEN kind IN (0, 1) THEN about WHEN kind = 2 AND n % 2 = 1 THEN 'x' END AS summary,
         CASE WHEN kind IN (0, 1) THEN n_clauses ELSE 0 END AS n_clauses, kind
  FROM bodies)"""


@query(f"""WITH {PKG}, {REPORTS}
SELECT url, ok, CAST(status_code AS VARCHAR) AS status_code, error, raw_response, grade, score, summary FROM envelopes""")
def policy_reports(spark, sf_dir):
    return S.report_envelopes(V.policy_reports(spark, sf_dir)).select(
        "url", "ok", F.col("status_code").cast("string"), "error", "raw_response", "report.grade", "report.score",
        "report.summary",
    )


@query(f"""WITH {PKG}
SELECT {V.policy_url_sql('n')} AS url, 'policy-' || n || '.html' AS source_file,
       CASE WHEN n % 2 = 0 THEN n + 30 END AS retention_days
FROM packages WHERE n % 5 IN (0, 1)""")
def policy_open_fields(spark, sf_dir):
    """Keys that the report's fixed fields do not name come back, as the service sent them."""
    n = F.regexp_extract("url", r"pkg(\d+)", 1)
    days = F.when(n.cast("int") % 2 == 0, F.concat(F.lit(',"retention":{"days":'), (n.cast("int") + 30).cast("string"), F.lit("}")))
    extra = F.concat(F.lit('{"sources":["policy-'), n, F.lit('.html"]'), F.coalesce(days, F.lit("")), F.lit(","))
    reports = V.policy_reports(spark, sf_dir).withColumn(
        "body", F.when(F.col("body").startswith("{"), F.concat(extra, F.expr("substring(body, 2)"))).otherwise(F.col("body"))
    )
    envelopes = S.report_envelopes(reports).where("ok")
    return envelopes.select(
        "url", F.variant_get("content", "$.sources[0]", "string").alias("source_file"),
        F.try_variant_get("content", "$.retention.days", "int").alias("retention_days"),
    )


@query(f"""WITH {SCORED}, {REPORTS}
SELECT s.manifest_id, s.name, s.privacy_policy_url, e.n IS NOT NULL AS report_available,
       coalesce(e.grade, 'N/A') AS grade,
       CASE WHEN e.score IS NULL THEN ''
            WHEN e.score = floor(e.score) THEN CAST(e.score AS BIGINT) || '/100'
            ELSE CAST(e.score AS VARCHAR) || '/100' END AS score_text,
       CASE WHEN e.kind IN (0, 1) THEN 'tracking: ' || (e.n % 6) || ', sharing: 1.5' ELSE '' END
         AS breakdown,
       CAST(e.status_code AS VARCHAR) AS http_status, e.error AS report_error,
       greatest(e.n_clauses - 5, 0) AS more_clauses
FROM scored s LEFT JOIN envelopes e ON e.url = s.privacy_policy_url
WHERE s.privacy_policy_url IS NOT NULL""")
def report_display(spark, sf_dir):
    return _package_check(spark, sf_dir).reports.select(
        "manifest_id", "name", "privacy_policy_url", "report_available", "grade", "score_text",
        "breakdown", F.col("http_status").cast("string"), "report_error", "more_clauses",
    )


@query(f"""WITH {SCORED}, {REPORTS},
shown AS (
  SELECT s.manifest_id, s.name, e.n_clauses,
         unnest(range(1, least(e.n_clauses, 5) + 1)) AS clause_no
  FROM scored s JOIN envelopes e ON e.url = s.privacy_policy_url)
SELECT manifest_id, name, clause_no,
       CASE clause_no % 3 WHEN 1 THEN 'class ' || clause_no WHEN 2 THEN 'cat ' || clause_no
            ELSE 'Clause' END AS label,
       CASE WHEN clause_no % 2 = 0 THEN 'insight ' || clause_no
            WHEN clause_no % 3 <> 0 THEN 'text ' || clause_no ELSE '' END AS text,
       CASE WHEN clause_no = 4 THEN 'fine' END AS fine_label,
       greatest(n_clauses - 5, 0) AS more_clauses
FROM shown""")
def report_clauses(spark, sf_dir):
    return clause_rows(_package_check(spark, sf_dir).reports, "manifest_id", "name")


# -- streams -------------------------------------------------------------------

def _document_stream(spark, sf_dir) -> DataFrame:
    """The document table as a stream, be it one file or a folder of files."""
    schema = V.table(spark, sf_dir, "documents").schema
    # a stream takes folders and patterns, so the table's own name is given as a pattern
    return V.file_diffs_of(spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]"))


def _scratch(spark) -> str:
    """A new folder of its own for each run."""
    return f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"


STREAM_SQL = f"""WITH {DIFFS},
kept AS (SELECT * FROM file_diffs WHERE NOT {Q.should_skip('file_path')}),
{Q.issue_ctes('kept', 'file_idx')}
SELECT file_idx, overall_risk, n_issues FROM file_results"""


@query(STREAM_SQL)
def stream_scan(spark, sf_dir):
    """Documents arriving as a stream, scanned statelessly; equals the batch scan."""
    out = _scratch(spark)
    scanned = scan_stream(_document_stream(spark, sf_dir)).select(
        "file_idx", "overall_risk", F.size("issues").alias("n_issues")
    )
    done = (
        scanned.writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _arrivals(spark, df: DataFrame, batches: list, out: str, start) -> None:
    """Run a stream of the rows in the order of ``batches`` (conditions), one micro-batch each.

    A batch is all that was written since the last one, in as many files as the rows have partitions.
    ``start`` gets the stream and the trigger. Only the last run goes on until the watermark has
    closed what it can: a batch without rows in between would make later rows late.
    """
    for k, rows in enumerate(batches, 1):
        df.where(rows).write.mode("append").parquet(f"{out}/arrivals")
        trigger = {"availableNow": True} if k == len(batches) else {"once": True}
        start(spark.readStream.schema(df.schema).parquet(f"{out}/arrivals"), trigger).awaitTermination()


COPIES_STREAM = f"""{COPIES},
kept AS (SELECT * FROM copied_diffs WHERE NOT {Q.should_skip('file_path')}),
{Q.issue_ctes('kept', 'file_idx')},
own AS (
  SELECT f.file_idx, f.is_doc, f.file_path, f.overall_risk, f.n_issues, sha256(k.diff) AS diff_hash,
         f.file_idx % 3 AS batch
  FROM file_results f JOIN kept k USING (file_idx))"""


@query(f"""WITH {COPIES_STREAM},
asked AS (
  SELECT * FROM own
  QUALIFY row_number() OVER (PARTITION BY diff_hash, batch ORDER BY is_doc, file_path) = 1),
stored AS (
  SELECT diff_hash, batch AS since, overall_risk AS known_risk, n_issues AS known_issues FROM asked
  WHERE overall_risk <> 'LOW' QUALIFY row_number() OVER (PARTITION BY diff_hash ORDER BY batch) = 1),
met AS (SELECT *, coalesce(batch > since, false) AS from_cache FROM own LEFT JOIN stored USING (diff_hash))
SELECT file_idx, from_cache, CASE WHEN from_cache THEN known_risk ELSE overall_risk END AS overall_risk,
       CASE WHEN from_cache THEN known_issues ELSE n_issues END AS n_issues FROM met""")
def stream_cached_scan(spark, sf_dir):
    """Three batches with copies of diffs, against a cache that fills and is compacted meanwhile."""
    out = _scratch(spark)
    files = V.copied_diffs(spark, sf_dir)

    def start(stream, trigger):
        return start_cached_scan(
            stream, f"{out}/cache", f"{out}/rows", f"{out}/state", compact_every=2, **trigger
        )

    _arrivals(spark, files, [F.col("file_idx") % 3 == i for i in range(3)], out, start)
    return spark.read.parquet(f"{out}/rows").select(
        "file_idx", "from_cache", "overall_risk", F.size("issues").alias("n_issues")
    )


@query(f"""WITH {COPIES_STREAM}
SELECT diff_hash, CAST(1 AS BIGINT) AS n_files FROM own GROUP BY diff_hash""")
def stream_once_per_diff(spark, sf_dir):
    """The first arrival of each diff passes, in whatever batch its copies come."""
    out = _scratch(spark)
    files = V.copied_diffs(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.col("file_idx") + 1_700_000_000))

    def start(stream, trigger):
        passed = once_per_diff(S.prepare_files(stream), "ts", "30 days").select("file_idx", "diff_hash")
        return passed.writeStream.format("parquet").option("path", f"{out}/rows").option(
            "checkpointLocation", f"{out}/state"
        ).trigger(**trigger).start()

    _arrivals(spark, files, [F.col("file_idx") % 3 == i for i in range(3)], out, start)
    return spark.read.parquet(f"{out}/rows").groupBy("diff_hash").agg(F.count(F.lit(1)).alias("n_files"))


EVENT_DIFFS = (
    "event_diffs AS (SELECT event_id AS file_idx, ts, 'src/' || event_type || '.ts' AS file_path, "
    f"'+' || {V._pick_sql(V.PLANTED, 'event_id')} || chr(10) || '+' || props AS diff FROM events)"
)


@query(f"""WITH {EVENT_DIFFS},
{Q.issue_ctes('event_diffs', 'file_idx')},
placed AS (SELECT file_idx, date_trunc('hour', ts) AS w, file_idx % 10 AS arrival, ts FROM event_diffs),
passed AS (  -- before the last batch, the watermark closed the windows of this time
  SELECT max(ts) FILTER (WHERE arrival > 1) - INTERVAL 1 HOUR AS first_mark, max(ts) - INTERVAL 1 HOUR AS last_mark
  FROM placed)
SELECT strftime(p.w, '%Y-%m-%d %H:%M:%S') AS window_start, i.severity, count(*) AS n_issues
FROM issues i JOIN placed p USING (file_idx), passed
WHERE p.w + INTERVAL 1 HOUR <= last_mark AND (arrival > 0 OR p.w + INTERVAL 1 HOUR > first_mark)
GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Issues per hour and severity over the event stream, in append mode.

    A window comes out once, when the watermark passes its end, and its state goes. Every tenth
    event arrives too late: only those whose window is still open count.
    """
    out = _scratch(spark)
    # events are small for the patterns they meet: few splits or row groups would leave cores idle
    events = V.table(spark, sf_dir, "events").hint("rebalance")
    late = F.col("event_id") % 10

    def start(stream, trigger):
        diffs = stream.select(
            F.col("event_id").alias("file_idx"), F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("src/"), "event_type", F.lit(".ts")).alias("file_path"),
            F.concat(
                F.lit("+"), V._pick(V.PLANTED, F.col("event_id")), F.lit("\n+"), F.col("props")
            ).alias("diff"),
        )
        counts = issues_per_window(O.scan_rules(diffs), "ts")
        return counts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option(
            "checkpointLocation", f"{out}/state"
        ).trigger(**trigger).start()

    _arrivals(spark, events, [late > 1, late == 1, late == 0], out, start)
    return spark.read.parquet(f"{out}/rows").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "severity", "n_issues",
    )
