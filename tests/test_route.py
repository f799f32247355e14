import json

from pyspark.sql import functions as F

from tests import model
from veilsift.operators.route import merge_verdicts, parse_verdict, route
from veilsift.operators.scan import scan_rules
from veilsift.plans import review_requests, score_requests


def test_truth_table(spark):
    rows = [(d, r, p) for d in (True, False) for r in ("LOW", "MEDIUM", "HIGH")
            for p in ("LOW", "MEDIUM", "HIGH")]
    df = spark.createDataFrame(rows, "d boolean, r string, p string")
    for x in df.withColumn("way", route(F.col("d"), F.col("r"), F.col("p"))).collect():
        if x.d:
            assert x.way == "local_doc"
        elif x.r == "HIGH":
            assert x.way == "local_high"
        elif x.r == "LOW" and x.p == "LOW":
            assert x.way == "local_low_path"
        else:
            assert x.way == "review"


def reply(issues, fence=False):
    text = json.dumps({"overall_risk": "LOW", "summary": "s", "issues": [
        {"file": "f", "severity": sev, "issue": txt} for txt, sev in issues]})
    return f"```json\n{text}\n```" if fence else text


def test_parse(spark):
    cases = [
        reply([("a", "LOW")]), reply([("a", "LOW")], fence=True), '{"summary": "only"}',
        '{"issues": [', "no json", '{"issues": []} and more', "", None, '{"issues": 3, "summary": "x"}',
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, r string")
    rows = {x.i: x.v for x in df.withColumn("v", parse_verdict(F.col("r"))).collect()}
    assert rows[0].issues[0].issue == "a" and rows[1].issues[0].issue == "a"
    assert rows[2].issues is None and rows[2].summary == "only"
    assert all(rows[i] is None for i in (3, 4, 5, 6, 7))
    assert rows[8].issues is None


def test_merge(spark):
    mail = "+m = ann.lee" + "@acme.net"
    files = spark.createDataFrame(
        [("h1", "a.ts", mail), ("h2", "a.ts", mail), ("h3", "a.md", mail), ("h4", "a.ts", mail)],
        "diff_hash string, file_path string, diff string",
    )
    local = model.scan(mail, False)[0][3]
    scanned = scan_rules(files).withColumn(
        "route", F.when(F.col("file_path") == "a.md", "local_doc").otherwise("review"))
    new = [(local, "HIGH"), ("new", "HIGH"), ("new", "HIGH")]
    verdicts = spark.createDataFrame(
        [("h1", reply(new, True)), ("h2", "broken"), ("h3", reply(new)), ("h4", '{"summary": "x"}')],
        "diff_hash string, response string",
    )
    rows = {r.diff_hash: r for r in merge_verdicts(scanned, verdicts).collect()}
    # a local text is not repeated, the reviewer's own duplicates stay
    assert [i.issue for i in rows["h1"].issues] == [local, "new", "new"]
    assert rows["h1"].overall_risk == "HIGH" and rows["h1"].summary == "s"
    assert rows["h1"].merged and rows["h1"].called
    for h in ("h2", "h3", "h4"):
        assert not rows[h].merged and rows[h].overall_risk == "MEDIUM"
        assert len(rows[h].issues) == 1
    assert [rows[h].called for h in ("h2", "h3", "h4")] == [False, False, True]


def test_review_and_scorer(spark):
    mail, key = "ann.lee" + "@acme.net", "k = \"sk-" + "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1\""
    files = spark.createDataFrame(
        [("h1", "a.ts", f"+m {mail}", "review"), ("h1", "b.ts", f"+m {mail}", "review"),
         ("h2", "c.ts", f"+{key}", "review"), ("h3", "d.ts", "+x", "local_doc")],
        "diff_hash string, file_path string, diff string, route string",
    )
    requests = review_requests(files)
    rows = {r.diff_hash: r for r in requests.collect()}
    assert set(rows) == {"h1", "h2"}
    assert rows["h1"].request_text == 'Review this diff for file "a.ts":\n\n+m [REDACTED:pii-email]'
    assert {r.diff_hash for r in review_requests(files, "block").collect()} == {"h1"}

    def scorer(batch):
        return batch.map(lambda t: '{"issues": []}' if "pii-email" in t else None)

    assert [tuple(r) for r in score_requests(requests, scorer).collect()] == [
        ("h1", '{"issues": []}', None)]


def test_a_failing_scorer_keeps_all_other_replies(spark):
    def scorer(texts):
        if (texts == "text 13").any():
            raise KeyError("13")
        if len(texts) > 1 and (texts == "text 40").any():
            return texts.iloc[1:]  # too few
        return texts.where(texts != "text 7")

    requests = spark.range(64).select(
        F.concat(F.lit("h"), "id").alias("diff_hash"), F.concat(F.lit("text "), "id").alias("request_text")
    ).coalesce(1)
    rows = {r.diff_hash: r for r in score_requests(requests, scorer).collect()}
    assert set(rows) == {f"h{i}" for i in range(64) if i != 7}  # null: no reply
    assert (rows["h13"].response, rows["h13"].error) == (None, "KeyError: '13'")
    assert all(r.response == f"text {h[1:]}" and r.error is None for h, r in rows.items() if h != "h13")
