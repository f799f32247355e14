import json

import pytest
from pyspark.sql import functions as F

from veilsift.functions.text import html_escape, package_prompt, plain_number
from veilsift.operators.packages import (
    clause_rows, dependency_report, package_results, parse_package_verdicts, report_display,
    score_counts,
)
from veilsift.plans import check_packages, scoring_requests
from veilsift.sources import (
    dependency_lists, manifest_dependencies, parse_reference, read_manifests, read_reference,
    report_envelopes, unique_reference,
)

DOCUMENT = """# Packages

Intro with ## inside a line.

---

## Servers & Routing

### 1. **express**
Fast web framework
- **npm**: https://npm.acme.net/express
- **Security Policy**: https://sec.acme.net/1
- **GitHub**: https://git.acme.net/1

### 2. **@hapi/hapi** (Maintenance Mode)
Server framework
- **npm**: https://npm.acme.net/@hapi/hapi
- **Privacy Policy**: https://hapi.acme.net/privacy
- **Note**: Use `express` or `koa`
- **GitHub**: https://git.acme.net/2

---

## HTTP

### 3. **request** (Deprecated)
- **npm**: https://npm.acme.net/request
- **GitHub**: https://git.acme.net/3

---

## Additional Resources

### npm docs
- **Privacy Policy**: https://docs.acme.net/privacy
"""


def manifests(spark):
    # maps come from JSON, which keeps the order of the names
    df = spark.createDataFrame(
        [("m1", '{"b": "1", "a": "2"}', '{"a": "9", "c": "3"}'), ("m2", None, '{"a": "1"}'),
         ("m3", "{}", None)],
        "manifest_id string, dependencies string, devDependencies string",
    )
    return df.withColumns({
        c: F.from_json(c, "map<string,string>") for c in ("dependencies", "devDependencies")
    })


def test_merge(spark):
    rows = manifest_dependencies(manifests(spark)).orderBy("manifest_id", "ordinal").collect()
    assert [(r.manifest_id, r.name, r.version, r.is_dev) for r in rows] == [
        ("m1", "b", "1", False), ("m1", "a", "9", True), ("m1", "c", "3", True),
        ("m2", "a", "1", True)]
    lists = {r.manifest_id: (r.n_dependencies, r.dependency_list)
             for r in dependency_lists(manifests(spark)).collect()}
    assert lists == {"m1": (3, "b@1\na@9\nc@3"), "m2": (1, "a@1"), "m3": (0, "")}


def test_read_manifests(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(
        {"name": "app", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}, indent=2))
    rows = manifest_dependencies(read_manifests(spark, str(tmp_path))).collect()
    assert sorted((r.name, r.version) for r in rows) == [("a", "^1"), ("b", "2")]
    assert rows[0].manifest_id.endswith("x.json")


def test_reference_document(spark, tmp_path):
    path = tmp_path / "ref.md"
    path.write_text(DOCUMENT)
    rows = parse_reference(read_reference(spark, [str(path)])).orderBy("ordinal").collect()
    assert [r.name for r in rows] == ["express", "@hapi/hapi", "request"]
    assert [r.category for r in rows] == ["Servers & Routing"] * 2 + ["HTTP"]
    assert [r.status for r in rows] == [None, "Maintenance Mode", "Deprecated"]
    assert [r.description for r in rows] == ["Fast web framework", "Server framework", None]
    assert rows[0].privacy_url is None and rows[0].security_url == "https://sec.acme.net/1"
    assert rows[1].privacy_url == "https://hapi.acme.net/privacy"
    assert rows[1].note == "Use `express` or `koa`"
    assert parse_reference(read_reference(spark, [])).count() == 0


def test_verdicts(spark):
    good = json.dumps([{"name": "a", "version": "1", "score": "SAFE", "privacyPolicyUrl": None}])
    df = spark.createDataFrame(
        [(1, good), (2, f"```json\n{good}\n```"), (3, good[:-1]), (4, "{}"), (5, "[]")],
        "manifest_id int, response string")
    rows = parse_package_verdicts(df).collect()
    assert sorted((r.manifest_id, r.name, r.score) for r in rows) == [
        (1, "a", "SAFE"), (2, "a", "SAFE")]


@pytest.fixture(scope="module")
def envelopes(spark):
    report = {"grade": "B", "score": 72, "risk_level": "low", "summary": "fine", "domain": "d",
              "risk_breakdown": {"x": 2, "y": 1.5},
              "clauses": [{"classification": f"c{i}", "text": f"t{i}"} for i in range(7)]}
    rows = [
        ("u1", 200, json.dumps(report), None),
        ("u2", 200, json.dumps({"data": report, "grade": "Z"}), None),
        ("u3", 500, json.dumps({"error": "own text", "summary": "s"}), None),
        ("u4", 503, json.dumps({}), None),
        ("u5", 200, '{"grade": ', None),
        ("u6", None, None, "timeout"),
        ("u7", None, None, "reset"),
        ("u8", 200, json.dumps({"ok": False, "clauses": [{"type": "t", "summary": "m"}, {}]}), None),
    ]
    df = spark.createDataFrame(
        rows, "url string, status_code int, body string, transport_error string")
    return report_envelopes(df)


def test_envelopes(envelopes):
    rows = {r.url: r for r in envelopes.collect()}
    assert rows["u1"].ok and rows["u1"].report.grade == "B" and rows["u1"].raw_response is None
    assert rows["u2"].report.grade == "B"  # the inner object as a whole
    assert (rows["u3"].ok, rows["u3"].error, rows["u3"].status_code) == (False, "own text", 500)
    assert rows["u3"].raw_response and rows["u3"].report.summary == "s"
    assert rows["u4"].error == "Policy report service returned HTTP 503"
    assert rows["u5"].error == "Failed to parse policy report response"
    assert rows["u5"].report is None and rows["u5"].raw_response == '{"grade": '
    assert rows["u6"].error == "Policy report request timed out after 240 seconds"
    assert rows["u7"].error == "Policy report request failed: reset"
    assert not rows["u8"].ok


def test_results_and_display(spark, envelopes):
    deps = spark.createDataFrame(
        [("m", 0, "a", "1", False), ("m", 1, "b", "1", False), ("m", 2, "c", "1", True),
         ("m", 3, "d", "1", True)],
        "manifest_id string, ordinal int, name string, version string, is_dev boolean")
    reference = spark.createDataFrame(
        [(1, "cat", "a", None, "u1", None), (2, "cat", "b", None, "", None),
         (7, "dup", "a", None, "zz", None)],
        "ordinal int, category string, name string, status string, privacy_url string, "
        "security_url string")
    verdicts = spark.createDataFrame(
        [("a", "HIGH_RISK", "u9"), ("b", "CAUTION", "u8"), ("c", "SAFE", "nowhere")],
        "name string, score string, privacy_policy_url string")
    for c in ("reason", "alternative", "regulation"):
        verdicts = verdicts.withColumn(c, F.lit(None).cast("string"))
    from veilsift.operators.packages import attach_reports
    results = attach_reports(
        package_results(deps, unique_reference(reference), verdicts), envelopes)
    rows = {r["name"]: r for r in results.collect()}
    assert {n: (r.score, r.privacy_policy_url) for n, r in rows.items()} == {
        "a": ("HIGH_RISK", "u1"), "b": ("CAUTION", "u8"), "c": ("SAFE", "nowhere"),
        "d": ("UNSCORED", None)}
    assert score_counts(results).first() == (1, 1, 1, 1)
    assert [r["name"] for r in dependency_report(results).collect()] == ["a", "b", "c", "d"]
    shown = report_display(results)
    by_name = {r["name"]: r for r in shown.collect()}
    assert set(by_name) == {"a", "b", "c"}
    a = by_name["a"]
    assert (a.grade, a.score_text, a.breakdown, a.more_clauses) == ("B", "72/100", "x: 2, y: 1.5", 2)
    assert len(a.top_clauses) == 5
    assert (by_name["b"].grade, by_name["b"].score_text) == ("N/A", "")
    assert not by_name["c"].report_available and by_name["c"].more_clauses == 0
    clauses = clause_rows(shown, "name").where("name = 'b'").orderBy("clause_no").collect()
    assert [(c.label, c.text) for c in clauses] == [("t", "m"), ("Clause", "")]


def test_whole_check(spark, envelopes):
    empty_reports = spark.createDataFrame(
        [], "url string, status_code int, body string, transport_error string")
    verdicts = spark.createDataFrame(
        [], "name string, score string, reason string, alternative string, regulation string, "
        "privacy_policy_url string")
    documents = spark.createDataFrame([(DOCUMENT,)], "text string")
    done = check_packages(manifests(spark), parse_reference(documents), verdicts, empty_reports)
    assert done.results.count() == 4
    assert [r.manifest_id for r in done.empty_manifests.collect()] == ["m3"]
    assert {r.manifest_id: r.n_unscored for r in done.counts.collect()} == {"m1": 3, "m2": 1}
    requests = {r.manifest_id: r.request_text for r in scoring_requests(manifests(spark)).collect()}
    assert set(requests) == {"m1", "m2"}
    assert requests["m2"].endswith("Score these npm packages for privacy risk:\n\na@1")


def test_small_functions(spark):
    df = spark.createDataFrame([('<a href="x">&</a>', 72.0, 1.25), (None, None, None)],
                               "t string, x double, y double")
    rows = df.select(
        html_escape(F.col("t")).alias("e"), plain_number(F.col("x")).alias("x"),
        plain_number(F.col("y")).alias("y"),
        package_prompt(F.lit("l"), F.lit("ref")).alias("p"),
    ).collect()
    assert tuple(rows[0])[:3] == ("&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;", "72", "1.25")
    assert rows[1].e == ""
    assert "\n\nref\n\nScore" in rows[0].p
