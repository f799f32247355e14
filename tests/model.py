"""A plain-Python statement of the semantics, one text at a time, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from veilsift.rules import (
    DEFAULT_RULES, DOC_SUFFIXES, EXAMPLE_ALLOWLIST, HIGH_RISK_PATHS, LATE_REDACTION_RULES,
    LOW_RISK_PATHS, SAFE_REFERENCES, SKIP_INFIX, SKIP_SUFFIXES,
)

COMPILED = [
    re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0))
    for r in DEFAULT_RULES
]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def is_example(line: str) -> bool:
    return any(v.upper() in line.upper() for v in EXAMPLE_ALLOWLIST)


def is_doc(path: str) -> bool:
    return path.lower().endswith(DOC_SUFFIXES)


def skipped(path: str) -> bool:
    p = path.lower()
    return p.endswith(SKIP_SUFFIXES) or SKIP_INFIX in p or p.split("/")[-1] == "package-lock.json" \
        or p.split("/")[-1] == "pnpm-lock.yaml"


def path_risk(path: str) -> str:
    p = path.lower()
    if any(re.search(x, p) for x in HIGH_RISK_PATHS):
        return "HIGH"
    return "LOW" if any(re.search(x, p) for x in LOW_RISK_PATHS) else "MEDIUM"


def risk(severities) -> str:
    found = set(severities)
    return "HIGH" if "HIGH" in found else "MEDIUM" if "MEDIUM" in found else "LOW"


def scan(diff: str, doc: bool) -> list[tuple[str, str, str, str]]:
    """(rule id, hint, severity, issue) per rule that fires."""
    lines = [x for x in diff.split("\n") if x.startswith("+") and not x.startswith("+++")]
    joined, out = "\n".join(lines), []
    for rule, pattern in zip(DEFAULT_RULES, COMPILED):
        if (doc and rule.skip_on_docs) or not pattern.search(joined):
            continue
        line = next((x for x in lines if pattern.search(x)), "")
        hint = (line[1:] if line.startswith("+") else line).strip()
        if is_example(hint):
            continue
        if rule.min_entropy is not None:
            m = pattern.search(hint)
            secret = re.sub("['\"]", "", m[0]).strip() if m else ""
            if secret and entropy(secret) < rule.min_entropy:
                continue
        out.append((rule.rule_id, hint[:120], rule.severity, rule.issue))
    return out


def redact(text: str) -> tuple[str, list[tuple[str, str]]]:
    """Redacted text and (rule id, matched text) findings."""
    found = []
    for rule, pattern in zip(DEFAULT_RULES, COMPILED):
        if not rule.redactable:
            continue
        for line in text.split("\n"):
            if any(s in line for s in SAFE_REFERENCES) or is_example(line):
                continue
            for m in pattern.finditer(line):
                secret = re.sub("['\"]", "", m[0]).strip()
                if rule.min_entropy is not None and secret and entropy(secret) < rule.min_entropy:
                    continue
                found.append((rule.rule_id, m[0]))
    ordered = sorted(found, key=lambda f: (f[0] in LATE_REDACTION_RULES, -len(f[1])))
    done = set()
    for rule_id, value in ordered:
        if value not in done and value in text:
            text = text.replace(value, f"[REDACTED:{rule_id}]")
            done.add(value)
    return text, found


def check_run(files, cache, verdicts):
    """Files of one run in order: (path, diff) -> (path, route, risk, issue texts)."""
    cache, out = dict(cache), []
    for path, diff in files:
        if skipped(path) or not diff.strip():
            continue
        key = hashlib.sha256(diff.encode()).hexdigest()
        if key in cache:
            level, texts = cache[key]
            out.append((path, "cached", level, texts))
            continue
        issues = scan(diff, is_doc(path))
        texts, level = [i[3] for i in issues], risk(i[2] for i in issues)
        if is_doc(path):
            route = "local_doc"
        elif level == "HIGH":
            route = "local_high"
        elif level == "LOW" and path_risk(path) == "LOW":
            route = "local_low_path"
        else:
            route = "review"
        store = True
        if route == "review":
            reply = verdicts.get(key)
            if reply is None:
                store = False
            else:
                new = [v for v in reply if v[0] not in set(texts)]
                level = risk([i[2] for i in issues] + [v[1] for v in new])
                texts = texts + [v[0] for v in new]
        if store and level != "LOW":
            cache[key] = (level, texts)
        out.append((path, route, level, texts))
    return out
