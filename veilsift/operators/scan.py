"""Rule scan: one issue per rule and file, from the lines a diff adds.

Everything is row-local: one chain of projections, no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_doc_file
from ..functions.regex import (
    any_literal, constant_array, sql_text, to_java,
)
from ..functions.text import (
    added_lines, hint_text, is_example, secret_candidate, shannon_entropy,
)
from ..rules import DEFAULT_RULES, MAX_HINT_CHARS, Guard, Rule
from .once import computed_once

_LINES, _ADDED, _HITS, _DOC = "_vs_lines", "_vs_added", "_vs_hits", "_vs_doc"


def detector(rule: Rule) -> str:
    """The Java pattern that tells whether the rule matches somewhere."""
    return to_java(rule.detect or rule.matcher or rule.pattern, rule.ignore_case)


def matcher(rule: Rule) -> str:
    """The Java pattern whose matches are the rule's matches."""
    return to_java(rule.matcher or rule.pattern, rule.ignore_case)


def with_guards(
    df: DataFrame, text: Column, rules: Sequence[Rule]
) -> tuple[DataFrame, dict[Guard, str]]:
    """Evaluate each distinct guard once per row, as boolean columns."""
    names = {g: f"_vs_guard{i}" for i, g in enumerate(dict.fromkeys(
        r.guard for r in rules if r.guard is not None
    ))}
    tests = {}
    for guard, name in names.items():
        parts = []
        if guard.literals:
            parts.append(any_literal(text, guard.literals))
        if guard.pattern:
            parts.append(text.rlike(to_java(guard.pattern, guard.ignore_case)))
        tests[name] = parts[0] if len(parts) == 1 else parts[0] & parts[1]
    return (df.withColumns(tests) if tests else df), names


def _occurs_sql(rule: Rule, text: str) -> str:
    return rule.walk.format(text=text) if rule.walk else f"{text} RLIKE {sql_text(detector(rule))}"


def matching_lines_sql(rule: Rule, lines: str) -> str:
    """SQL for the lines of an array column in which the rule's pattern occurs."""
    return f"filter({lines}, item -> {_occurs_sql(rule, 'item')})"


def match_sql(rule: Rule, text_col: str, guards: dict[Guard, str]) -> str:
    """SQL test that the rule's pattern occurs in a text column."""
    test = _occurs_sql(rule, f"`{text_col}`")
    return f"({guards[rule.guard]} AND {test})" if rule.guard in guards else f"({test})"


def low_entropy(rule_min: Column | float, secret: Column) -> Column:
    """A non-empty candidate below the minimum is taken for an example value."""
    return (secret != "") & (shannon_entropy(secret) < rule_min)


def _hit_sql(rule: Rule, guards: dict[Guard, str]) -> str:
    """Code-only rules pass over documentation files."""
    test = match_sql(rule, _ADDED, guards)
    return f"NOT {_DOC} AND {test}" if rule.skip_on_docs else test


def minimum_entropy(rules: Sequence[Rule], rule_pos: Column) -> Column:
    """The rule's minimum, 0 where it has none."""
    return F.get(F.array(*[F.lit(float(r.min_entropy or 0.0)) for r in rules]), rule_pos)


def rule_field(rules: Sequence[Rule], name: str, rule_pos: Column) -> Column:
    """A text field of the rule at a position in ``rules``."""
    values = [getattr(r, name) for r in rules]
    value = F.get(constant_array(values), rule_pos)
    return F.nullif(value, F.lit("")) if None in values else value


def _secret_of(hit: Column, rules: Sequence[Rule]) -> Column:
    secret = None
    for i, rule in enumerate(rules):
        if rule.min_entropy is None:
            continue
        match = F.regexp_extract(hit.hint, matcher(rule), 0)
        test = hit.i == i
        secret = F.when(test, match) if secret is None else secret.when(test, match)
    return F.lit("") if secret is None else secret_candidate(F.coalesce(secret, F.lit("")))


def _with_added(df: DataFrame, diff_col: str, path_col: str, doc_col: str | None) -> DataFrame:
    doc = F.col(doc_col) if doc_col else is_doc_file(F.col(path_col))
    return (
        df.withColumn(_LINES, added_lines(F.col(diff_col)))
        .withColumn(_DOC, doc)
        .withColumn(_ADDED, F.array_join(F.col(_LINES), "\n"))
    )


def rule_hits(
    df: DataFrame,
    diff_col: str = "diff",
    path_col: str = "file_path",
    rules: Sequence[Rule] = DEFAULT_RULES,
    doc_col: str | None = None,
) -> DataFrame:
    """One row per file and rule whose pattern occurs in the added text.

    This is the scan before the allowlist and entropy tests.
    """
    rules = tuple(rules)
    keep = [c for c in df.columns if c != diff_col]
    added, guards = with_guards(
        _with_added(df, diff_col, path_col, doc_col), F.col(_ADDED), rules
    )
    hits = F.array(*[
        F.expr(f"CASE WHEN {_hit_sql(r, guards)} THEN {i} END") for i, r in enumerate(rules)
    ])
    found = added.withColumn(_HITS, F.filter(hits, lambda h: h.isNotNull()))
    return (
        computed_once(found.select(*keep, _HITS), _HITS)
        .select(*keep, F.explode(_HITS).alias("rule_idx"))
        .withColumn("rule_id", rule_field(rules, "rule_id", F.col("rule_idx")))
    )


def scan_rules(
    df: DataFrame,
    diff_col: str = "diff",
    path_col: str = "file_path",
    rules: Sequence[Rule] = DEFAULT_RULES,
    doc_col: str | None = None,
    use_guards: bool = True,
    max_hint_chars: int | None = MAX_HINT_CHARS,
    all_lines: bool = False,
) -> DataFrame:
    """Add ``issues``, ``overall_risk`` and ``summary`` to every row.

    ``doc_col`` names an existing boolean column; without it the path decides.
    ``max_hint_chars`` bounds the line shown with an issue; ``None`` shows it whole.
    A rule reports its first matching line; with ``all_lines`` every matching line, so
    that a placeholder hides no later secret.
    Rules are unrolled into literal patterns, which Spark compiles once per task.
    """
    rules = tuple(rules)
    added, guards = with_guards(
        _with_added(df, diff_col, path_col, doc_col), F.col(_ADDED), rules if use_guards else ()
    )
    def hit_sql(i: int, rule: Rule) -> str:
        lines = matching_lines_sql(rule, _LINES)
        if all_lines:  # a match that spans lines has none of its own, and one empty hint
            found = f"transform(concat({lines}, array('')), line -> struct({i} AS i, line AS line))"
            found = f"slice({found}, 1, greatest(size({lines}), 1))"
        else:
            found = f"struct({i} AS i, get({lines}, 0) AS line)"
        return f"CASE WHEN {_hit_sql(rule, guards)} THEN {found} END"

    hits = F.array(*[F.expr(hit_sql(i, rule)) for i, rule in enumerate(rules)])
    found = F.array_compact(F.col(_HITS))
    hinted = F.transform(
        F.flatten(found) if all_lines else found,
        # no single line matches when the match spans lines: the hint is empty then
        lambda h: F.struct(
            h.i.alias("i"), hint_text(F.coalesce(h.line, F.lit(""))).alias("hint")
        ),
    )
    checked = F.filter(
        F.transform(
            F.filter(hinted, lambda h: ~is_example(h.hint)),
            lambda h: F.struct(
                h.i.alias("i"), h.hint.alias("hint"), _secret_of(h, rules).alias("secret")
            ),
        ),
        lambda h: ~low_entropy(minimum_entropy(rules, h.i), h.secret),
    )
    path = F.col(path_col)

    def issue(h: Column) -> Column:
        return F.struct(
            h.i.alias("rule_idx"),
            rule_field(rules, "rule_id", h.i).alias("rule_id"),
            path.alias("file"),
            (h.hint if max_hint_chars is None else F.substring(h.hint, 1, max_hint_chars)).alias("line_hint"),
            *[
                rule_field(rules, name, h.i).alias(name)
                for name in ("severity", "issue", "fix", "regulation")
            ],
        )

    scanned = (
        added.withColumn(_HITS, hits)
        .withColumn("issues", F.transform(checked, issue))
        .drop(_LINES, _ADDED, _HITS, _DOC, *guards.values())
    )
    return computed_once(scanned, "issues").withColumns({
        "overall_risk": risk_of(F.col("issues")),
        "summary": local_summary(F.col("issues")),
    })


def risk_of(issues: Column) -> Column:
    """Highest severity in an issue array; LOW when empty."""
    return (
        F.when(F.exists(issues, lambda i: i.severity == "HIGH"), F.lit("HIGH"))
        .when(F.exists(issues, lambda i: i.severity == "MEDIUM"), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def local_summary(issues: Column) -> Column:
    return F.when(F.size(issues) == 0, F.lit("No issues detected by local scan.")).otherwise(
        F.concat(F.size(issues).cast("string"), F.lit(" issue(s) found by local pattern scan."))
    )


def issue_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    """One row per issue, in rule order within a file."""
    return scanned.select(*keys, F.posexplode("issues").alias("issue_pos", "_i")).select(
        *keys, "issue_pos", "_i.*"
    )
