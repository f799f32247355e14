"""Outbound filter: find sensitive values in text and replace them.

Row-local. Rows where no redactable rule can match skip all line work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_example, is_safe_reference, secret_candidate, split_lines
from ..rules import DEFAULT_RULES, LATE_REDACTION_RULES, Rule
from .once import computed_once
from .scan import (
    low_entropy, match_sql, matcher, matching_lines_sql, minimum_entropy, rule_field, with_guards,
)

MODES = ("redact", "block", "warn", "off")
_FLAGS, _LINES, _HITS = "_vs_flags", "_vs_lines", "_vs_hits"


def _matched_lines(rules: Sequence[Rule]) -> Column:
    """``(rule position, line)`` of every line a rule matches, rule by rule."""
    return F.flatten(F.array_compact(F.array(*[
        F.expr(
            f"CASE WHEN {_FLAGS}[{i}] THEN transform("
            f"{matching_lines_sql(rule, _LINES)}, line -> struct({i} AS i, line AS line)"
            ") END"
        )
        for i, rule in enumerate(rules)
    ])))


def _values_in(hit: Column, rules: Sequence[Rule]) -> Column:
    """All matches of the hit's rule in its line, in text order."""
    found = None
    for i, rule in enumerate(rules):
        matches = F.regexp_extract_all(hit.line, F.lit(matcher(rule)), F.lit(0))
        found = F.when(hit.i == i, matches) if found is None else found.when(hit.i == i, matches)
    return found


def find_sensitive(
    df: DataFrame,
    text_col: str,
    rules: Sequence[Rule] = DEFAULT_RULES,
    findings_col: str = "findings",
) -> DataFrame:
    """Add an array of ``(rule_id, category, severity, matched_text)``.

    Safe references and allowlisted lines are passed over. Order: rule, line,
    position.
    """
    active = tuple(r for r in rules if r.redactable)
    text = F.col(text_col)
    guarded, guards = with_guards(df, text, active)
    flagged = guarded.withColumn(
        # a match inside one line is a match in the whole text, so this only
        # rules rows and rules out
        _FLAGS,
        F.array(*[F.expr(f"coalesce({match_sql(r, text_col, guards)}, false)") for r in active]),
    )
    lined = flagged.withColumn(
        _LINES, F.when(F.array_contains(F.col(_FLAGS), True), split_lines(text))
    ).withColumn(
        _HITS,
        # the line tests run on matched lines only
        F.filter(
            _matched_lines(active), lambda h: ~is_safe_reference(h.line) & ~is_example(h.line)
        ),
    )
    values = F.flatten(F.transform(
        F.col(_HITS),
        lambda h: F.transform(
            _values_in(h, active), lambda m: F.struct(h.i.alias("i"), m.alias("m"))
        ),
    ))
    kept = F.filter(
        values,
        lambda v: ~low_entropy(minimum_entropy(active, v.i), secret_candidate(v.m)),
    )
    findings = F.transform(kept, lambda v: F.struct(
        *[rule_field(active, n, v.i).alias(n) for n in ("rule_id", "category", "severity")],
        v.m.alias("matched_text"),
    ))
    found = lined.withColumn(findings_col, findings).drop(
        _FLAGS, _LINES, _HITS, *guards.values()
    )
    return computed_once(found, findings_col)


def _replacements(findings: Column) -> Column:
    """The distinct values to replace, in the order they must be replaced.

    Each text is owned by its first finding; late rules come after all others,
    longer values before shorter ones, then finding order.
    """
    ranked = F.array_sort(F.transform(
        findings,
        lambda f, i: F.struct(
            f.matched_text.alias("m"),
            f.rule_id.isin(*LATE_REDACTION_RULES).cast("int").alias("late"),
            i.alias("pos"),
            f.rule_id.alias("rule_id"),
        ),
    ))
    # equal texts are neighbours now: keep the first of each run, in linear time
    # (the one-element array binds the sorted list once)
    owners = F.flatten(F.transform(
        F.array(ranked),
        lambda all_: F.filter(
            all_, lambda f, i: (i == 0) | (f.m != F.get(all_, F.greatest(i - 1, F.lit(0))).m)
        ),
    ))
    return F.array_sort(F.transform(
        owners,
        lambda f: F.struct(
            f.late.alias("late"),
            (-F.length(f.m)).alias("neg_len"),
            f.pos.alias("pos"),
            f.m.alias("m"),
            F.concat(F.lit("[REDACTED:"), f.rule_id, F.lit("]")).alias("token"),
        ),
    ))


#: Up to this many values, each is replaced in the whole text.
FEW_VALUES = 32
#: Characters of a piece of text, about, and pieces that are searched for values at once.
_PIECE, _BLOCK = 256, 16
#: Values from this length on are looked up by this many characters at each end.
_LONG = 12
#: Characters a text may be cut behind, if none of its values has them.
_CUTS = (" ", "\t", ",", ";", '"', "'", "<", ">", "{", "}", "|", "=", "(", ")")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _in_turn(text: Column, values: Column) -> Column:
    return F.aggregate(values, text, lambda acc, f: F.replace(acc, f.m, f.token))


def _pieces(text: Column, values: Column, protect_safe_lines: bool) -> Column:
    """``(t, safe)``: the text cut where no value can lie across; joined they are the text."""

    def cut(all_values: Column) -> Column:
        unused = F.filter(F.array(*map(F.lit, _CUTS)), lambda c: ~F.contains(all_values, c))
        return _let(F.array_join(unused, ""), lambda c: F.concat(
            F.lit(f"(?s).{{{_PIECE}}}[^\n"), c, F.lit("]*+[\n"), c, F.lit("]|.+")
        ))

    def piece(t: Column, safe: bool) -> Column:
        return F.struct(t.alias("t"), F.lit(safe).alias("safe"))

    def all_pieces(pattern: Column) -> Column:
        def open_pieces(part: Column) -> Column:
            return F.transform(
                F.regexp_extract_all(part, pattern, F.lit(0)), lambda t: piece(t, False)
            )

        if not protect_safe_lines:
            return open_pieces(text)
        return F.flatten(F.transform(
            F.split(text, "(?<=\n)", -1),
            lambda line: F.when(is_safe_reference(line), F.array(piece(line, True))).otherwise(open_pieces(line)),
        ))

    return _let(cut(F.array_join(F.transform(values, lambda f: f.m), "")), all_pieces)


def _ends(values: Column) -> Column:
    """Values with the characters at both ends that a text with them must have, and all such ends."""

    def keyed(width: Column) -> Column:
        with_ends = F.transform(values, lambda f: F.struct(
            f.alias("f"), F.substring(f.m, F.lit(1), width).alias("head"), F.right(f.m, width).alias("tail"),
        ))
        return _let(with_ends, lambda v: F.struct(
            width.alias("width"), v.alias("values"),
            F.array_distinct(F.concat(F.transform(v, lambda x: x.head), F.transform(v, lambda x: x.tail))).alias("ends"),
        ))

    shortest = F.array_min(F.transform(values, lambda f: F.length(f.m)))
    return _let(F.least(shortest, F.lit(_LONG)), keyed)


def _met(text: Column, keyed: Column) -> Column:
    """The values whose ends the text has: with them, all that it has."""

    def both_ends(found: Column) -> Column:
        met = F.filter(
            keyed["values"], lambda v: F.array_contains(found, v.head) & F.array_contains(found, v.tail)
        )
        return F.transform(met, lambda v: v.f)

    every_place = F.concat(F.lit("(?s)(?=(.{"), keyed["width"].cast("string"), F.lit("}))"))
    none = F.transform(F.slice(keyed["values"], 1, 0), lambda v: v.f)
    return F.when(F.size(keyed["values"]) == 0, none).otherwise(
        _let(F.array_intersect(F.regexp_extract_all(text, every_place, F.lit(1)), keyed["ends"]), both_ends)
    )


def _piece_by_piece(text: Column, values: Column, protect_safe_lines: bool) -> Column:
    """The same as replacing value by value in the whole text, for many values.

    A piece is searched for the values it has, which a few look-ups tell. A value it does not
    have can only appear in it by way of an inserted token: such a value has a bracket, or is
    part of a token.
    """
    in_tokens = _let(F.array_distinct(F.transform(values, lambda f: f.token)), lambda tokens: F.filter(
        values, lambda f: f.m.rlike(r"[\[\]]") | F.exists(tokens, lambda t: F.contains(t, f.m))
    ))
    long = F.filter(values, lambda f: F.length(f.m) >= _LONG)
    short = F.filter(values, lambda f: F.length(f.m) < _LONG)

    def replaced(piece: Column, near: Column, always: Column) -> Column:
        own = F.filter(near, lambda f: F.contains(piece.t, f.m))
        return F.when(piece.safe, piece.t).otherwise(_let(own, lambda f: F.when(F.size(f) == 0, piece.t).otherwise(
            _in_turn(piece.t, F.array_sort(F.array_distinct(F.concat(f, always))))
        )))

    def blocks(pieces: Column, long_keys: Column, short_keys: Column, always: Column) -> Column:
        def block(i: Column) -> Column:
            return _let(F.slice(pieces, i * _BLOCK + 1, F.lit(_BLOCK)), lambda part: _let(
                F.array_join(F.transform(F.filter(part, lambda p: ~p.safe), lambda p: p.t), ""),
                lambda t: _let(
                    F.concat(_met(t, long_keys), _met(t, short_keys)),
                    lambda near: F.array_join(F.transform(part, lambda p: replaced(p, near, always)), ""),
                ),
            ))

        last = F.greatest(F.floor((F.size(pieces) - 1) / _BLOCK).cast("int"), F.lit(0))
        return F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")

    return _let(_pieces(text, values, protect_safe_lines), lambda pieces: _let(
        _ends(long), lambda long_keys: _let(
            _ends(short), lambda short_keys: _let(
                in_tokens, lambda always: blocks(pieces, long_keys, short_keys, always)
            ),
        ),
    ))


def apply_replacements(text: Column, findings: Column, protect_safe_lines: bool = False) -> Column:
    """Replace every found value everywhere in the text, also on passed-over lines.

    With ``protect_safe_lines``, lines with a safe reference stay as they are. Values are
    replaced one after the other: a later one may match inside an earlier one's token. Many
    values are not each looked for in the whole text, but in the pieces that have their ends,
    as far as the text can be cut where no value lies across.
    """

    def few(values: Column) -> Column:
        if not protect_safe_lines:
            return _in_turn(text, values)
        return F.array_join(F.transform(
            split_lines(text),
            lambda line: F.when(is_safe_reference(line), line).otherwise(_in_turn(line, values)),
        ), "\n")

    return F.when(F.size(findings) == 0, text).otherwise(_let(
        _replacements(findings),
        lambda values: F.when(F.size(values) <= FEW_VALUES, few(values)).otherwise(
            _piece_by_piece(text, values, protect_safe_lines)
        ),
    ))


def redact(
    df: DataFrame, text_col: str, rules: Sequence[Rule] = DEFAULT_RULES,
    protect_safe_lines: bool = False,
) -> DataFrame:
    """Add ``redacted``, ``findings`` and ``has_high``."""
    found = find_sensitive(df, text_col, rules)
    return found.withColumns({
        "redacted": apply_replacements(F.col(text_col), F.col("findings"), protect_safe_lines),
        "has_high": has_high(F.col("findings")),
    })


def has_high(findings: Column) -> Column:
    return F.exists(findings, lambda f: f.severity == "HIGH")


def rule_summary(findings: Column) -> Column:
    """Distinct rule ids in first-seen order."""
    return F.array_join(F.array_distinct(F.transform(findings, lambda f: f.rule_id)), ", ")


def _outbound(mode: str, text: Column, redacted: Column, findings: Column) -> Column:
    """``(mode, outbound_text, outbound_status, outbound_rules)`` under one mode."""
    hit = F.size(findings) > 0
    rules = rule_summary(findings)
    if mode == "off":
        sent, status, rules = text, F.lit("off"), F.lit("")
    elif mode == "warn":
        sent, status = text, F.when(~hit, F.lit("clean")).otherwise(F.lit("warned"))
    else:
        sent, status = redacted, F.when(~hit, F.lit("clean"))
        if mode == "block":
            status = status.when(has_high(findings), F.lit("blocked"))
            sent = F.when(~has_high(findings), redacted)
        status = status.otherwise(F.lit("redacted"))
    return F.struct(
        F.lit(mode).alias("mode"), sent.alias("outbound_text"), status.alias("outbound_status"),
        rules.alias("outbound_rules"),
    )


def outbound_filter(
    df: DataFrame,
    text_col: str,
    mode: str = "redact",
    rules: Sequence[Rule] = DEFAULT_RULES,
    protect_safe_lines: bool = False,
) -> DataFrame:
    """What may leave, under one of ``MODES`` (unknown values act as ``redact``).

    Adds ``outbound_text`` (null when blocked), ``outbound_status`` and
    ``outbound_rules``. Mode ``off`` does no scan at all.
    """
    mode = (mode or "redact").lower()
    text, findings = F.col(text_col), F.col("_vs_findings")
    found = df if mode == "off" else find_sensitive(df, text_col, rules, findings_col="_vs_findings")
    out = _outbound(mode, text, apply_replacements(text, findings, protect_safe_lines), findings)
    return found.withColumns({
        c: out[c] for c in ("outbound_text", "outbound_status", "outbound_rules")
    }).drop("_vs_findings")


def outbound_by_mode(
    df: DataFrame,
    text_col: str,
    modes: Sequence[str] = MODES,
    rules: Sequence[Rule] = DEFAULT_RULES,
    protect_safe_lines: bool = False,
) -> DataFrame:
    """Each row once for each mode, with ``mode`` and what ``outbound_filter`` adds.

    The text is scanned once and its values are replaced once, whatever the number of modes.
    """
    text, findings = F.col(text_col), F.col("_vs_findings")
    found = find_sensitive(df, text_col, rules, findings_col="_vs_findings").withColumn(
        "_vs_redacted", apply_replacements(text, findings, protect_safe_lines)
    )
    ways = [_outbound((m or "redact").lower(), text, F.col("_vs_redacted"), findings) for m in modes]
    return computed_once(found, "_vs_redacted").select(
        *df.columns, F.inline(F.array(*ways))
    )
