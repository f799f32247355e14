"""SQL building blocks: the scan, redaction and rollup semantics in plain DuckDB SQL."""

from __future__ import annotations

from veilsift.rules import (
    DEFAULT_RULES, DOC_SUFFIXES, EXAMPLE_ALLOWLIST, HIGH_RISK_PATHS, LATE_REDACTION_RULES,
    LOW_RISK_PATHS, MAX_DIFF_CHARS, MAX_HINT_CHARS, SAFE_REFERENCES, Rule, SKIP_INFIX, SKIP_NAMES,
    SKIP_SUFFIXES, TRUNCATION_MARKER,
)

from .views import quote


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else quote(value)


def rules_cte() -> str:
    rows = ",\n    ".join(
        "(" + ", ".join([
            str(i), _text(r.rule_id), _text(("(?i)" if r.ignore_case else "") + r.pattern),
            _text(r.severity), _text(r.issue), _text(r.fix), _text(r.regulation),
            f"CAST({r.min_entropy if r.min_entropy is not None else 'NULL'} AS DOUBLE)",
            str(r.skip_on_docs).lower(), _text(r.category), str(r.redactable).lower(),
        ]) + ")"
        for i, r in enumerate(DEFAULT_RULES)
    )
    return (
        "rules(rule_idx, rule_id, pattern, severity, issue, fix, regulation, min_entropy, "
        f"skip_on_docs, category, redactable) AS (VALUES\n    {rows})"
    )


def _pattern(rule: Rule) -> str:
    return quote(("(?i)" if rule.ignore_case else "") + rule.pattern)


def _per_rule(select: str, source: str, test: str, only_redactable: bool = False) -> str:
    """One branch per rule, so that each pattern is a constant; ``{p}`` is the pattern."""
    return "\n  UNION ALL ".join(
        f"SELECT {select.format(p=_pattern(r))}, {i} AS rule_idx FROM {source} "
        f"WHERE {test.format(p=_pattern(r))}"
        for i, r in enumerate(DEFAULT_RULES) if r.redactable or not only_redactable
    )


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def is_example(line: str) -> str:
    tests = " OR ".join(
        f"contains(upper({line}), {quote(v.upper())})" for v in EXAMPLE_ALLOWLIST
    )
    return f"({tests})"


def is_safe(line: str) -> str:
    return "(" + " OR ".join(f"contains({line}, {quote(v)})" for v in SAFE_REFERENCES) + ")"


def secret(match: str) -> str:
    return trim(f"replace(replace({match}, '''', ''), '\"', '')")


def entropy(x: str) -> str:
    """Shannon entropy; characters are listed and counted, 0 for empty text."""
    n = f"CAST(length({x}) AS DOUBLE)"
    share = f"(len(list_filter(string_split({x}, ''), lambda d: d = c)) / {n})"
    return (
        f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE "
        f"list_sum(list_transform(list_distinct(string_split({x}, '')), "
        f"lambda c: -{share} * log2({share}))) END"
    )


def should_skip(path: str) -> str:
    p = f"lower({path})"
    ends = " OR ".join(f"ends_with({p}, {quote(s)})" for s in SKIP_SUFFIXES)
    names = ", ".join(quote(n) for n in SKIP_NAMES)
    return f"({ends} OR contains({p}, {quote(SKIP_INFIX)}) OR {base_name(path)} IN ({names}))"


def base_name(path: str) -> str:
    return f"string_split(lower({path}), '/')[-1]"


def is_doc(path: str) -> str:
    return "(" + " OR ".join(f"ends_with(lower({path}), {quote(s)})" for s in DOC_SUFFIXES) + ")"


def path_risk(path: str) -> str:
    def any_of(patterns: tuple[str, ...]) -> str:
        return " OR ".join(f"regexp_matches(lower({path}), {quote(p)})" for p in patterns)

    return (
        f"CASE WHEN {any_of(HIGH_RISK_PATHS)} THEN 'HIGH' "
        f"WHEN {any_of(LOW_RISK_PATHS)} THEN 'LOW' ELSE 'MEDIUM' END"
    )


def cut(diff: str) -> str:
    marker = quote(TRUNCATION_MARKER)
    return (
        f"CASE WHEN length({diff}) > {MAX_DIFF_CHARS} "
        f"THEN left({diff}, {MAX_DIFF_CHARS}) || {marker} ELSE {diff} END"
    )


def added_ctes(source: str) -> str:
    """``added``: the source's rows with ``is_doc``, ``path_risk``, added lines and text."""
    lines = (
        "list_filter(string_split(diff, chr(10)), "
        "lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++'))"
    )
    return (
        f"lined AS (SELECT *, {is_doc('file_path')} AS is_doc, "
        f"{path_risk('file_path')} AS path_risk, {lines} AS lines FROM {source}),\n"
        "added AS (SELECT *, array_to_string(lines, chr(10)) AS added FROM lined)"
    )


def issue_ctes(source: str, keys: str, all_lines: bool = False) -> str:
    """``issues`` and ``file_results`` over ``source`` (keys, file_path, diff)."""
    found = "list_filter(a.lines, lambda l: regexp_matches(l, {p}))"
    line = f"coalesce({found}[1], '')"
    if all_lines:
        line = f"unnest(CASE WHEN len({found}) = 0 THEN [''] ELSE {found} END)"
    k = ", ".join(f"a.{c.strip()}" for c in keys.split(","))
    return f"""{rules_cte()},
{added_ctes(source)},
matched AS (
  {_per_rule(
      k + f", a.file_path, a.is_doc, a.path_risk, {line} AS line",
      "added a", "regexp_matches(a.added, {p})")}),
hits AS (
  SELECT * FROM matched JOIN rules USING (rule_idx) WHERE NOT (is_doc AND skip_on_docs)),
hinted AS (
  SELECT *, {trim("regexp_replace(line, '^\\+', '')")} AS hint FROM hits),
candidates AS (
  SELECT *, CASE WHEN min_entropy IS NULL THEN ''
            ELSE {secret("regexp_extract(hint, pattern, 0)")} END AS secret
  FROM hinted WHERE NOT {is_example('hint')}),
issues AS (
  SELECT * REPLACE (left(hint, {MAX_HINT_CHARS}) AS hint) FROM candidates
  WHERE min_entropy IS NULL OR secret = '' OR NOT ({entropy('secret')} < min_entropy)),
per_file AS (
  SELECT {keys}, count(*) AS n_issues,
         count(*) FILTER (WHERE severity = 'HIGH') AS n_high,
         count(*) FILTER (WHERE severity = 'MEDIUM') AS n_medium
  FROM issues GROUP BY {keys}),
file_results AS (
  SELECT {k}, a.file_path, a.is_doc, a.path_risk,
         coalesce(p.n_issues, 0) AS n_issues, coalesce(p.n_high, 0) AS n_high,
         coalesce(p.n_medium, 0) AS n_medium,
         CASE WHEN p.n_high > 0 THEN 'HIGH' WHEN p.n_medium > 0 THEN 'MEDIUM' ELSE 'LOW' END
           AS overall_risk,
         CASE WHEN p.n_issues IS NULL THEN 'No issues detected by local scan.'
              ELSE p.n_issues || ' issue(s) found by local pattern scan.' END AS summary
  FROM added a LEFT JOIN per_file p USING ({keys}))"""


ROUTE = """CASE WHEN is_doc THEN 'local_doc' WHEN overall_risk = 'HIGH' THEN 'local_high'
  WHEN overall_risk = 'LOW' AND path_risk = 'LOW' THEN 'local_low_path' ELSE 'review' END"""


def finding_ctes(source: str, keys: str, text: str, with_rules: bool = True) -> str:
    """``findings``: every sensitive value, with its order within the row (``pos``)."""
    k = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
    rules = f"{rules_cte()},\n" if with_rules else ""
    return f"""{rules}text_lines AS (
  SELECT {k}, unnest(string_split(s.{text}, chr(10))) AS line,
         generate_subscripts(string_split(s.{text}, chr(10)), 1) AS line_no
  FROM {source} s),
open_lines AS (
  SELECT * FROM text_lines WHERE NOT {is_safe('line')} AND NOT {is_example('line')}),
matches AS (
  {_per_rule(
      "l.*, regexp_extract_all(l.line, {p}, 0) AS found", "open_lines l",
      "regexp_matches(l.line, {p})", only_redactable=True)}),
valued AS (
  SELECT * EXCLUDE (found), unnest(found) AS matched_text,
         generate_subscripts(found, 1) AS match_no
  FROM matches JOIN rules USING (rule_idx)),
tested AS (
  SELECT *, {secret('matched_text')} AS secret FROM valued),
findings AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rule_idx, line_no, match_no) AS pos
  FROM tested
  WHERE min_entropy IS NULL OR secret = '' OR NOT ({entropy('secret')} < min_entropy))"""


def _replaced(text: str) -> str:
    """The text with every value of ``d.todo`` replaced, one after the other."""
    return f"""list_reduce(
             list_prepend({{'acc': {text}, 'm': '', 't': ''}}, d.todo),
             lambda a, b: {{'acc': replace(a.acc, b.m, b.t), 'm': '', 't': ''}}).acc"""


def redact_ctes(
    source: str, keys: str, text: str, with_rules: bool = True, protect_safe_lines: bool = False,
) -> str:
    """``redacted``: keys, original text, redacted text and finding counts."""
    replaced = _replaced(f"s.{text}")
    if protect_safe_lines:
        replaced = (
            f"array_to_string(list_transform(string_split(s.{text}, chr(10)), "
            f"lambda l: CASE WHEN {is_safe('l')} THEN l ELSE {_replaced('l')} END), chr(10))"
        )
    late = ", ".join(quote(r) for r in LATE_REDACTION_RULES)
    k = ", ".join(f"s.{c.strip()}" for c in keys.split(","))
    return f"""{finding_ctes(source, keys, text, with_rules)},
ranked AS (
  SELECT *, rule_id IN ({late}) AS late,
         row_number() OVER (PARTITION BY {keys}, matched_text
           ORDER BY (rule_id IN ({late})), pos) AS copy_no
  FROM findings),
steps AS (
  SELECT {keys},
         list({{'acc': '', 'm': matched_text, 't': '[REDACTED:' || rule_id || ']'}}
              ORDER BY late, length(matched_text) DESC, pos)
           FILTER (WHERE copy_no = 1) AS todo,
         count(*) AS n_findings, bool_or(severity = 'HIGH') AS has_high
  FROM ranked GROUP BY {keys}),
summaries AS (
  SELECT {keys}, string_agg(rule_id, ', ' ORDER BY first_pos) AS rules_found
  FROM (SELECT {keys}, rule_id, min(pos) AS first_pos FROM findings GROUP BY {keys}, rule_id)
  GROUP BY {keys}),
redacted AS (
  SELECT {k}, s.{text} AS original, coalesce(d.n_findings, 0) AS n_findings,
         coalesce(d.has_high, false) AS has_high, coalesce(u.rules_found, '') AS rules_found,
         CASE WHEN d.todo IS NULL THEN s.{text} ELSE {replaced} END AS redacted
  FROM {source} s LEFT JOIN steps d USING ({keys}) LEFT JOIN summaries u USING ({keys}))"""
