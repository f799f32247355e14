"""Explicit types for every table that enters or leaves the package."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _L, _I, _D = (
    T.StringType(), T.BooleanType(), T.LongType(), T.IntegerType(), T.DoubleType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


FILE_DIFFS = _struct(
    repo_id=_I, commit_no=_I, file_idx=_L, file_path=_S, change_type=_S, is_staged=_B, diff=_S,
)

ISSUE = _struct(
    rule_idx=_I, rule_id=_S, file=_S, line_hint=_S, severity=_S, issue=_S, fix=_S, regulation=_S,
)
RESULT = _struct(overall_risk=_S, summary=_S, issues=T.ArrayType(ISSUE))
SCAN_CACHE = _struct(
    diff_hash=_S, version=_I, ruleset_version=_S, written_at=T.TimestampType(), result=RESULT,
)

FINDING = _struct(rule_id=_S, category=_S, severity=_S, matched_text=_S)

# Replies of a reviewing model
MODEL_ISSUE = _struct(file=_S, line_hint=_S, severity=_S, issue=_S, fix=_S, regulation=_S)
MODEL_RESULT = _struct(overall_risk=_S, summary=_S, issues=T.ArrayType(MODEL_ISSUE))
PACKAGE_VERDICT = _struct(
    name=_S, version=_S, score=_S, reason=_S, alternative=_S, regulation=_S, privacyPolicyUrl=_S,
)

MANIFEST = _struct(
    name=_S,
    dependencies=T.MapType(_S, _S),
    devDependencies=T.MapType(_S, _S),
)

CLAUSE = _struct(
    classification=_S, category=_S, type=_S, plain_insight=_S, summary=_S, text=_S, fine_label=_S,
)
_REPORT_FIELDS = dict(
    domain=_S, score=_D, grade=_S, risk_level=_S, summary=_S, clause_count=_I,
    risk_breakdown=T.MapType(_S, _D), clauses=T.ArrayType(CLAUSE),
)
REPORT_DATA = _struct(**_REPORT_FIELDS)
POLICY_BODY = _struct(
    **_REPORT_FIELDS, data=REPORT_DATA, ok=_B, statusCode=_I, error=_S, rawResponse=_S,
)
POLICY_REPORTS = _struct(url=_S, status_code=_I, body=_S, transport_error=_S)

PACKAGE_REFERENCE = _struct(
    ordinal=_I, category=_S, name=_S, status=_S, description=_S, npm_url=_S, security_url=_S,
    privacy_url=_S, github_url=_S, note=_S,
)
