import random
import re
import time

from pyspark.sql import functions as F

from tests import model
from veilsift.functions.regex import to_java
from veilsift.functions.text import shannon_entropy, trim_text
from veilsift.operators.scan import match_sql, with_guards
from veilsift.rules import DEFAULT_RULES, Rule, rules_frame, ruleset_version
from workloads.views import PLANTED

PIECES = [
    "password", "passwd", "secret", "token", "api key", "api_key", "apikey", "iv", "NPI", "npi",
    "aws_secret_access_key", "Authorization", "Bearer ", "dob", "date of birth", "passport",
    "license key", "mrn", "patient id", "icd10", "condition", "client_secret", "secret_key",
    ":", "=", " = ", ":  ", " " * 10, '"', "'", "`", "//", "://", "http", "https", "@", ".com",
    "a.b", "console.log(", "console.warn (", ")", "user.email", "${", "}", "req.body.password",
    "req", "+1", "(415)", "415", "8675309", "-", "867-5309", "519-84-2277", "519842277", "10.1.2.3",
    "192.168.0.1", "172.20.1.9", "12 ", " Oak", " St", " Ave", " Rd", " Stone", " Way", "St", "999", "48.8, 2.35", "1,2", "742 Maple Ave", "12 Oak Tree St",
    "AKIA", "ASIA", "Q7XM2LV9RT4KP8WN", "gh", "ghp_", "github_pat_", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1",
    "sk-", "eyJ", "AIza", "sig=", "?", "&", "PO ", "contract #", "invoice", "purchase order",
    "TODO", "hack", "xxx", "FIXME", "confidential", "proprietary", "do not copy", "internal.",
    "staging.", "/webhook/", "localhost:8080", "127.0.0.1:90", "\n", "\n+", "é", "_", " ", "E11",
    "A12345", "send", "ga(", "gtag(", "mixpanel.track", "amplitude.logEvent", "segment.io",
    "analytics.track(", "navigator.geolocation.watchPosition", "fetch(", "axios.get(", "4/17/1988",
]


def texts(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choices(PIECES, k=rng.randint(1, 9))) for _ in range(n)]
    return out + list(PLANTED) + ["é" + p for p in PLANTED] + ["x" + p for p in PLANTED]


def test_counts_and_order():
    assert len(DEFAULT_RULES) == 43
    assert sum(r.severity == "HIGH" for r in DEFAULT_RULES) == 25
    assert sum(r.severity == "LOW" for r in DEFAULT_RULES) == 2
    assert sum(r.redactable for r in DEFAULT_RULES) == 28
    assert sum(r.skip_on_docs for r in DEFAULT_RULES) == 13
    assert sum(r.min_entropy is not None for r in DEFAULT_RULES) == 9
    assert len({r.rule_id for r in DEFAULT_RULES}) == 43


def test_guards_and_detectors_change_nothing(spark):
    """Guarded detection equals the plain pattern, and both equal Python's ASCII regex."""
    data = texts(4000, seed=11)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "id int, t string")
    guarded, guards = with_guards(df, F.col("t"), DEFAULT_RULES)
    row = guarded.select("id", *[
        F.expr(match_sql(r, "t", guards)).alias(f"g{i}") for i, r in enumerate(DEFAULT_RULES)
    ], *[
        F.col("t").rlike(to_java(r.pattern, r.ignore_case)).alias(f"p{i}")
        for i, r in enumerate(DEFAULT_RULES)
    ]).collect()
    hits = 0
    for r in row:
        for i, pattern in enumerate(model.COMPILED):
            expected = bool(pattern.search(data[r["id"]]))
            hits += expected
            where = (DEFAULT_RULES[i].rule_id, data[r["id"]])
            assert r[f"p{i}"] == expected, where
            assert r[f"g{i}"] == expected, where
    assert hits > 1000


def test_templates_in_log_calls(spark):
    """The walk over a text's events equals the pattern, and needs linear time."""
    rule = next(r for r in DEFAULT_RULES if r.walk)
    pattern = model.COMPILED[DEFAULT_RULES.index(rule)]
    rng = random.Random(31)
    parts = ["console.log(`", "Console.WARN \t(`", "console.log(", "`", "${", "$", "{", "}", "email", "TOKEN", "phon",
             "e", "ssn", "x", "\n", "phonetoken", "console.log(`${", "${email", "}"]
    data = ["".join(rng.choices(parts, k=rng.randint(2, 30))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(data)), "id int, t string")
    rows = df.select("id", F.expr(match_sql(rule, "t", {})).alias("hit")).collect()
    want = [bool(pattern.search(t)) for t in data]
    assert 300 < sum(want) < 5000 and [r.hit for r in sorted(rows)] == want
    call = "console.log(`"
    hostile = [(call + "${a ") * 60_000, (call + "${email ") * 40_000, call + "${a" * 300_000, call + "${" + "email" * 200_000,
               call + "${x} " * 200_000 + "${ssn}"]
    df = spark.createDataFrame([(t,) for t in hostile], "t string")
    began = time.time()
    assert [r.hit for r in df.select(F.expr(match_sql(rule, "t", {})).alias("hit")).collect()] == [False] * 4 + [True]
    assert time.time() - began < 30


def test_java_dialect():
    assert to_java(r"\bab") == r"(?<!\w)ab"
    assert to_java(r"\d{2}\b") == r"\d{2}(?!\w)"
    assert r"(?=\w)" in to_java(r"[ab]\b[cd]")
    assert to_java("[[]") == r"[\[]"
    assert to_java("a.b").startswith(r"a[^\n\r")
    assert to_java("x", ignore_case=True) == "(?i)x"


def test_spaces_and_boundaries(spark):
    df = spark.createDataFrame(
        [("é519-84-2277",), ("  a ﻿",), ("mrn = 88412",)], "t string"
    )
    rows = df.select(
        F.col("t").rlike(to_java(r"\b\d{3}-")).alias("edge"), trim_text(F.col("t")).alias("trim"),
        F.col("t").rlike(to_java(r"mrn\s*=\s*\d")).alias("space"),
    ).collect()
    assert rows[0].edge and rows[1].trim == "a" and rows[2].space


def test_entropy(spark):
    values = ["", "a", "ab", "aabb", "Qz7Lm2Xv9Rt4", "ééa", "😀😀ab", "x y\tz"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r.e for r in df.select(shannon_entropy(F.col("t")).alias("e")).collect()]
    for value, e in zip(values, got):
        assert abs(e - model.entropy(value)) < 1e-12


def test_version_follows_rules():
    extra = DEFAULT_RULES + (Rule("own", r"zzz\d", "LOW", "i", "f"),)
    assert ruleset_version(extra) != ruleset_version(DEFAULT_RULES)
    assert re.fullmatch(r"[0-9a-f]{16}", ruleset_version())


def test_rules_frame(spark):
    assert rules_frame(spark).count() == 43
