import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tests import model
from veilsift.operators.ordering import with_offsets
from veilsift.operators.rollup import number_issues
from veilsift.operators.scan import scan_rules
from veilsift.plans import check_changes
from veilsift.plans.check_changes import NOTHING_TO_SCAN
from veilsift.sources import (
    append_cache, cache_entries, changed_files, clear_cache, compact_cache, compact_in_place, crowded_prefixes,
    load_cache, pick_diff,
)
from workloads.views import PLANTED

PATHS = ["src/auth/a.ts", "src/utils/b.ts", "docs/c.md", "src/d.ts", "x.png", "lib/e.py"]
SCHEMA = "repo_id int, commit_no int, file_idx long, file_path string, diff string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def case():
    """Runs full of copies; a third of all rows are one diff in one run."""
    rng = random.Random(23)
    pool = [f"+{p}\n+tail" for p in PLANTED] + ["+clean", "-gone", "  \n", ""]
    files = [(1, 1, i, rng.choice(PATHS), pool[16]) for i in range(0, 400, 2)]
    files += [(1, 1, i, rng.choice(PATHS), rng.choice(pool)) for i in range(1, 400, 2)]
    files += [(rng.randint(1, 3), rng.randint(2, 4), i, rng.choice(PATHS), rng.choice(pool[10:25]))
              for i in range(400, 700)]
    files += [(9, 9, 0, "a.png", "+x"), (9, 9, 1, "b.lock", "+y"), (8, 8, 0, "a.ts", " ")]
    verdicts = {}
    for i, diff in enumerate(pool):
        if i % 3 == 0:
            verdicts[digest(diff)] = [(model.DEFAULT_RULES[i % 43].issue, "MEDIUM"), ("new", "HIGH")]
        elif i % 3 == 1:
            verdicts[digest(diff)] = [("only low", "LOW")]
    return files, verdicts


def verdict_frame(spark, verdicts):
    return spark.createDataFrame(
        [(h, json.dumps({"summary": "r", "issues": [
            {"issue": t, "severity": s} for t, s in v]})) for h, v in verdicts.items()],
        "diff_hash string, response string",
    )


def expected(files, cache, verdicts):
    out, runs = {}, {}
    for repo, commit, idx, path, diff in sorted(files):
        runs.setdefault((repo, commit), []).append((idx, path, diff))
    for run, items in runs.items():
        kept = [(i, p, d) for i, p, d in items if not model.skipped(p) and d.strip()]
        done = model.check_run([(p, d) for _, p, d in kept], cache, verdicts)
        for (i, _, _), (_, way, level, texts) in zip(kept, done):
            out[(*run, i)] = (way, level, texts)
    return out


def actual(result):
    return {
        (r.repo_id, r.commit_no, r.file_idx): (r.route, r.overall_risk, [i.issue for i in r.issues])
        for r in result.file_results.collect()
    }


@pytest.fixture(scope="module")
def checked(spark, case):
    files, verdicts = case
    return check_changes(
        spark.createDataFrame(files, SCHEMA), verdicts=verdict_frame(spark, verdicts))


def test_equals_one_by_one(checked, case):
    files, verdicts = case
    got, want = actual(checked), expected(files, {}, verdicts)
    assert got == want
    assert sum(v[0] == "cached" for v in want.values()) > 200


def test_without_verdicts(spark, case):
    files, _ = case
    assert actual(check_changes(spark.createDataFrame(files, SCHEMA))) == expected(files, {}, {})


def test_warm_cache(spark, checked, case, tmp_path):
    files, verdicts = case
    path = str(tmp_path / "cache")
    append_cache(checked.new_cache_entries, path, "first")
    cache = load_cache(spark, path)
    stored = {r.diff_hash: (r.result.overall_risk, [i.issue for i in r.result.issues])
              for r in cache.collect()}
    assert stored and all(v[0] != "LOW" for v in stored.values())
    again = check_changes(
        spark.createDataFrame(files, SCHEMA), cache=cache, verdicts=verdict_frame(spark, verdicts))
    assert actual(again) == expected(files, stored, verdicts)
    assert again.new_cache_entries.where(F.col("diff_hash").isin(*stored)).count() == 0


def test_run_results(checked, case):
    files, verdicts = case
    want = expected(files, {}, verdicts)
    rows = {(r.repo_id, r.commit_no): r for r in checked.run_results.collect()}
    assert rows[(9, 9)].summary == NOTHING_TO_SCAN and rows[(9, 9)].files_scanned == 0
    assert rows[(8, 8)].files_scanned == 1 and rows[(8, 8)].n_files == 0
    assert rows[(8, 8)].summary == "No privacy issues found across 0 scanned file(s)."
    assert not rows[(9, 9)].blocked
    for run, r in rows.items():
        mine = {k: v for k, v in want.items() if k[:2] == run}
        assert r.n_files == len(mine) and r.n_issues == sum(len(v[2]) for v in mine.values())
        assert r.cache_hits == sum(v[0] == "cached" for v in mine.values())
        assert r.overall_risk == model.risk(v[1] for v in mine.values())
        assert r.blocked == (r.overall_risk == "HIGH")


def test_numbering(checked):
    rows = checked.issues.orderBy("repo_id", "commit_no", "issue_no").collect()
    by_run = {}
    for r in rows:
        by_run.setdefault((r.repo_id, r.commit_no), []).append((r.issue_no, r.file_idx))
    for numbers in by_run.values():
        assert [n for n, _ in numbers] == list(range(1, len(numbers) + 1))
        assert [i for _, i in numbers] == sorted(i for _, i in numbers)


def test_offsets_with_small_blocks(spark):
    rng = random.Random(1)
    rows = [(0, i, rng.randint(0, 5)) for i in range(0, 900, 3)]
    rows += [(1, i, 2) for i in (0, 7, 8, 63, 64, 65, 4000)]
    df = spark.createDataFrame(rows, "run int, idx long, size int")
    got = {(r.run, r.idx): r.offset for r in with_offsets(df, ["run"], "idx", "size", block=8).collect()}
    for run in (0, 1):
        total = 0
        for _, i, n in sorted(r for r in rows if r[0] == run):
            assert got[(run, i)] == total
            total += n
    assert len(got) == len(rows)


def test_number_issues_by_other_keys(spark):
    df = spark.createDataFrame(
        [(1, i, "a.ts", f"+{PLANTED[28]}") for i in range(5)],
        "team int, file_idx long, file_path string, diff string")
    rows = number_issues(scan_rules(df), ["team"]).orderBy("issue_no").collect()
    assert [r.issue_no for r in rows] == list(range(1, 11))
    assert [r.rule_id for r in rows[:2]] == ["private-key", "cred-ssh-key"]


def test_changed_files(spark):
    rows = [(1, "a", "A", True), (1, "b", "M", False), (2, "c", "M", False), (2, "d", "D", True),
            (3, "e", "X", False)]
    df = spark.createDataFrame(rows, "repo_id int, f string, change_type string, is_staged boolean")
    assert {r.f for r in changed_files(df).collect()} == {"a", "c"}


def test_pick_diff(spark):
    df = spark.createDataFrame(
        [("s", "h"), (" \n", "h"), (None, "h"), (None, None)], "s string, h string")
    assert [r.diff for r in pick_diff(df, "s", "h").collect()] == ["s", "h", "h", ""]


def entries(spark, rows, version=None):
    df = spark.createDataFrame(rows, "diff_hash string, overall_risk string, summary string")
    return cache_entries(df.withColumn(
        "issues", F.array().cast("array<struct<rule_idx:int,rule_id:string,file:string,"
                                 "line_hint:string,severity:string,issue:string,fix:string,"
                                 "regulation:string>>")), version)


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "c")
    assert load_cache(spark, path).count() == 0  # no table yet
    append_cache(entries(spark, [("a", "HIGH", "old"), ("b", "LOW", "never")]), path, "p1")
    append_cache(entries(spark, [("a", "MEDIUM", "new"), ("c", "HIGH", "x")]), path, "p2")
    append_cache(entries(spark, [("z", "HIGH", "other")], version="another"), path, "p3")
    rows = {r.diff_hash: r.result.summary for r in load_cache(spark, path).collect()}
    assert rows == {"a": "new", "c": "x"}
    skipping = load_cache(spark, path, skip_part="p2").collect()
    assert {r.diff_hash: r.result.summary for r in skipping} == {"a": "old"}
    compact_cache(spark, path, str(tmp_path / "d"))
    again = load_cache(spark, str(tmp_path / "d")).collect()
    assert {r.diff_hash: r.result.summary for r in again} == rows
    clear_cache(spark, path)
    assert load_cache(spark, path).count() == 0


def test_compaction_in_place(spark, tmp_path):
    path = str(tmp_path / "c")
    hashes = [digest(str(i)) for i in range(40)]
    append_cache(entries(spark, [(h, "HIGH", "old") for h in hashes]), path, "p0")
    for i in range(1, 4):
        append_cache(entries(spark, [(h, "HIGH", f"new {i}") for h in hashes[:30]]), path, f"p{i}")
    append_cache(entries(spark, [(hashes[0], "HIGH", "other rules")], version="another"), path, "p4")
    read = lambda: {r.diff_hash: r.result.summary for r in load_cache(spark, path).collect()}
    want = read()
    assert want == {h: "new 3" if i < 30 else "old" for i, h in enumerate(hashes)}
    assert spark.read.parquet(path).count() == 131
    crowded = crowded_prefixes(spark, path, max_files=3)
    assert crowded == sorted({h[:2] for h in hashes[:30]})
    compact_in_place(spark, path, crowded[:5])
    assert read() == want and crowded_prefixes(spark, path, max_files=3) == crowded[5:]
    compact_in_place(spark, path)
    assert read() == want and spark.read.parquet(path).count() == 41  # one more of other rules
    assert load_cache(spark, path, version="another").first().result.summary == "other rules"
    compact_in_place(spark, path)  # a retry
    append_cache(entries(spark, [(h, "HIGH", "new 3") for h in hashes[:30]]), path, "p3")
    assert read() == want and spark.read.parquet(path).count() == 71
    compact_in_place(spark, str(tmp_path / "none"))
    assert crowded_prefixes(spark, str(tmp_path / "none")) == []


def test_files_given_twice(spark, case):
    files, verdicts = case
    twice = spark.createDataFrame([*files[:30], *files[:30], (1, 1, None, "src/n.ts", "+null key")], SCHEMA)
    rows = check_changes(twice, verdicts=verdict_frame(spark, verdicts)).file_results.collect()
    kept = [f for f in files[:30] if not model.skipped(f[3]) and f[4].strip()]
    assert len(rows) == 2 * len(kept) + 1 and sum(r.file_idx is None for r in rows) == 1
