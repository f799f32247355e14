import random
import time

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.test_rules import texts
from veilsift.functions.paths import is_doc_file, path_risk, should_skip
from veilsift.functions.text import cut_diff
from veilsift.functions.regex import to_java
from veilsift.operators.scan import detector, issue_rows, rule_hits, scan_rules
from veilsift.rules import DEFAULT_RULES, MAX_DIFF_CHARS, Rule
from workloads.views import PLANTED


def diffs(spark, rows):
    return spark.createDataFrame(rows, "file_idx long, file_path string, diff string")


def scanned(spark, rows, **options):
    out = {}
    for r in scan_rules(diffs(spark, rows), **options).collect():
        out[r.file_idx] = r
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(i, "src/a.ts", f"+++ b/src/a.ts\n-old\n+{p}\n+end") for i, p in enumerate(PLANTED)]
    rows[46] = (46, "src/a.ts", "-s = 519-" + "84-2277\n+clean line")
    return scanned(spark, rows)


def test_each_rule_fires(planted):
    for i, rule in enumerate(DEFAULT_RULES):
        assert rule.rule_id in {x.rule_id for x in planted[i].issues}
        fired = next(x for x in planted[i].issues if x.rule_id == rule.rule_id)
        assert (fired.severity, fired.fix, fired.regulation) == (
            rule.severity, rule.fix, rule.regulation)
        assert fired.file == "src/a.ts" and fired.line_hint == PLANTED[i].strip()


def test_edge_cases(planted):
    ids = {i: [x.rule_id for x in planted[i].issues] for i in range(43, 50)}
    assert ids[43] == [] and ids[44] == [] and ids[46] == []
    assert ids[45] == ["pii-email"]  # safe references count for redaction only
    assert ids[47] == ["pii-in-log-user-field"] and planted[47].issues[0].line_hint == ""
    assert ids[48] == []  # the first line is a placeholder and hides the second
    assert ids[49] == ["sk-key", "cred-generic-secret"]


def test_docs_skip_code_only_rules(spark):
    rows = [(0, "notes/a.md", "+gtag(1)\n+passwd = \"Zk93xq" + "Wv7p\""), (1, "a.ts", "+gtag(1)")]
    out = scanned(spark, rows)
    assert [x.rule_id for x in out[0].issues] == ["cred-generic-secret"]
    assert [x.rule_id for x in out[1].issues] == ["google-analytics"]
    assert out[1].overall_risk == "MEDIUM"
    assert out[1].summary == "1 issue(s) found by local pattern scan."


def test_empty_and_unmatched(spark):
    out = scanned(spark, [(0, "a.ts", ""), (1, "a.ts", " context\n-gone"), (2, "a.ts", "+++ b/x")])
    for r in out.values():
        assert r.issues == [] and r.overall_risk == "LOW"
        assert r.summary == "No issues detected by local scan."


def test_hint_is_cut(spark):
    line = "gtag(" + "y" * 300
    assert len(scanned(spark, [(0, "a.ts", "+  " + line)])[0].issues[0].line_hint) == 120


def test_own_rule(spark):
    rules = (*DEFAULT_RULES, Rule("own", r"zz\d+'", "LOW", "mine", "fix", ignore_case=True))
    out = scanned(spark, [(0, "a.ts", "+ZZ42'")], rules=rules)
    assert [(x.rule_id, x.regulation) for x in out[0].issues] == [("own", None)]


def test_against_model(spark):
    rng = random.Random(5)
    pool = texts(1500, seed=3)
    rows = []
    for i in range(900):
        body = "\n".join(rng.choice("++ -") + rng.choice(pool) for _ in range(rng.randint(1, 6)))
        rows.append((i, rng.choice(["a.ts", "b.md"]), body))
    plain = scanned(spark, rows)
    unguarded = scanned(spark, rows, use_guards=False)
    fired = 0
    for i, path, diff in rows:
        expected = model.scan(diff, model.is_doc(path))
        fired += len(expected)
        for out in (plain, unguarded):
            got = [(x.rule_id, x.line_hint, x.severity, x.issue) for x in out[i].issues]
            assert got == expected, diff
        assert plain[i].overall_risk == model.risk(e[2] for e in expected)
    assert fired > 500


def test_rule_hits_ignore_allowlist(spark):
    rows = rule_hits(diffs(spark, [(0, "a.ts", "+user" + "@example.com"), (1, "a.ts", "-x")]))
    assert [(r.file_idx, r.rule_id) for r in rows.collect()] == [(0, "pii-email")]


def test_issue_rows_order(spark):
    df = scan_rules(diffs(spark, [(0, "a.ts", f"+{PLANTED[28]}")]))
    assert [r.rule_id for r in issue_rows(df, "file_idx").orderBy("issue_pos").collect()] == [
        "private-key", "cred-ssh-key"]


@pytest.mark.parametrize("n,cut", [(5999, False), (6000, False), (6001, True)])
def test_cut(spark, n, cut):
    text = "x" * n
    got = spark.createDataFrame([(text,)], "d string").select(
        cut_diff(F.col("d"), MAX_DIFF_CHARS).alias("a"), cut_diff(F.col("d")).alias("b")
    ).first()
    assert got.a == ("x" * 6000 + "\n...(truncated)" if cut else text)
    assert got.b == text


def test_paths(spark):
    cases = {
        "a/Yarn.LOCK": (True, False, "MEDIUM"), "x.min.js": (True, False, "MEDIUM"),
        "package-lock.json": (True, False, "MEDIUM"), "go.sum": (True, False, "MEDIUM"),
        "src/lock.ts": (False, False, "MEDIUM"), "README.md": (False, True, "LOW"),
        "src/auth/test.ts": (False, False, "HIGH"), "src/utils/a.ts": (False, False, "LOW"),
        "webpack.config.js": (False, False, "HIGH"), "a/testXfixture": (False, False, "LOW"),
        "src/App.ts": (False, False, "MEDIUM"), "x.lock.ts": (False, False, "MEDIUM"),
    }
    p = F.col("p")
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    for r in df.select(
        "p", should_skip(p).alias("s"), is_doc_file(p).alias("d"), path_risk(p).alias("r")
    ).collect():
        assert (r.s, r.d, r.r) == cases[r.p], r.p
        assert r.d == model.is_doc(r.p) and r.r == model.path_risk(r.p)


PARTS = (
    "console.log(", "console.info (", "email", "user.email", "user.", " token", ")", "(", "\n", "\r", " ", "x", "`",
    "https://", "http://a", "/webhook/", "abcdefghijk", "\"", "TODO", " FIXME ", "todos", "password", "key",
)
SLOW_RULES = ("pii-in-log-field", "pii-in-log-user-field", "net-webhook-url", "biz-todo-sensitive")


def test_detectors_find_what_the_plain_patterns_find(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))),) for _ in range(3000)]
    rules = [r for r in DEFAULT_RULES if r.rule_id in SLOW_RULES]
    assert all(r.detect for r in rules) and len(rules) == len(SLOW_RULES)
    found = spark.createDataFrame(rows, "t string").select("t", *[
        F.col("t").rlike(p(r)).alias(f"{r.rule_id}{k}") for r in rules
        for k, p in enumerate((detector, lambda r: to_java(r.pattern, r.ignore_case)))
    ]).collect()
    for r in rules:
        assert [x[f"{r.rule_id}0"] for x in found] == [x[f"{r.rule_id}1"] for x in found], r.rule_id
        assert 3 < sum(x[f"{r.rule_id}0"] for x in found) < 2900


@pytest.mark.parametrize("piece", ["console.log(a ", "https://x", "TODO ", "console.log(user."])
def test_hostile_texts_take_linear_time(spark, piece):
    text = "+" + piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    rows = scan_rules(spark.createDataFrame([("a.ts", text)], "file_path string, diff string")).collect()
    assert rows[0].issues == [] and time.perf_counter() - start < 30
