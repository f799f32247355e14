"""Operator 5 against its SQL twin and plain Python."""

import re

import duckdb
from pyspark.sql import functions as F

from veilsift.llm import line_rules as L

SHARED = "Subscribe to our Weekly letter, now!"
MENU = [" ".join(f"menu{j} entry{j}x{k}" for k in range(10)) for j in range(4)]  # in a third of the documents


def rows():
    out = []
    for k in range(60):
        body = "\n".join(" ".join(f"own{k}x{j}x{i}" for i in range(10)) for j in range(6))
        shared = "\n".join([SHARED if k % 2 else SHARED.lower().replace(" ", "  "), *MENU])
        out.append((k, f"{body}\n{shared}" if k % 3 == 0 else body, "host" if k % 5 else None))
    many = " ".join(f"w{j}" for j in range(60))
    out.append((100, "\n".join([*MENU, "a b"]), "host"))  # little is left
    out.append((101, "x y z " * 40, "host"))  # repeats itself
    out.append((102, f"{many}\n\n \n{many}\n#*$ %&|<>\x0b\x0c", "host"))
    out += [(103, None, "host"), (104, "", "host"), (105, many, None), (106, "a b c a b c d", "other")]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    symbols = sum((text or "").count(c) for c in L.SYMBOLS)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    got = {r.doc_id: r for r in L.line_rules(frame(spark)).collect()}
    for doc_id, text, _ in rows():
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text), doc_id
    assert got[0].removed == [] and got[3].removed == [6, 7, 8, 9, 10] and got[100].removed == [0, 1, 2, 3]
    assert not got[100].kept and not got[100].base_failed and got[3].kept
    assert got[101].base_failed and got[103].base_failed and got[104].base_failed and got[105].kept


def same_as_twin(spark, tmp_path, docs):
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = L.op5_line_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(L.OP5_SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, cursor.fetchall()))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


def test_twin(spark, tmp_path):
    same_as_twin(spark, tmp_path, frame(spark).drop("kept"))


def test_documents_and_hosts_are_told_apart(spark, tmp_path):
    """A document given 12 times, one id in two hosts, a line in 5 % of a large host, very long texts."""
    body = lambda k: "\n".join(" ".join(f"own{k}x{j}x{i}" for i in range(10)) for j in range(6))
    banner = " ".join(f"banner{j}" for j in range(12))
    rows = [(1, body(1), "one")] * 12 + [(2, body(2), "one")]
    rows += [(k, body(k) + (f"\n{banner}" if k % 20 == 0 else ""), "large") for k in range(1000, 3000)]
    rows += [(1020, body(1020) + f"\n{banner}", "small"), (None, body(4), "one"), (None, body(5), "one")]
    rows += [(10_000, "\n".join(f"{banner} {j}" for j in range(8_000)), "large"), (10_001, banner * 4000, "large")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.host_key, r.removed, r.kept) for r in L.line_rules(df).collect()]
    assert got.count((1, "one", [], True)) == 12
    assert (1020, "large", [6], True) in got and (1020, "small", [], True) in got
    assert sum(removed == [6] for _, host, removed, _ in got if host == "large") == 100
    kept = [(r.doc_id, r.source, r.text) for r in L.apply_line_rules(df).collect()]
    assert (1020, "large", body(1020)) in kept and (1020, "small", f"{body(1020)}\n{banner}") in kept
    same_as_twin(spark, tmp_path, df)


def test_text_without_lines(spark):
    kept = {r.doc_id: r.text for r in L.apply_line_rules(frame(spark)).collect()}
    texts = {k: t for k, t, _ in rows()}
    assert 3 in kept and kept[3] == texts[3].rsplit("\n", 5)[0] and kept[1] == texts[1]
    assert not {100, 101, 103, 104, 106} & set(kept)
    cut = spark.createDataFrame(
        [("a\nb\nc\n", [0]), ("a\nb\nc\n", [1, 2]), ("a", [0]), ("a\n\nb", []), ("a\nb\nc\nd", [0, 3])],
        "t string, n array<int>",
    ).select(L.without_lines(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in cut] == ["b\nc\n", "a\n", "", "a\n\nb", "b\nc"]


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"word{j}" for j in range(60))
    df = spark.createDataFrame([(None, text, "h"), (1, text, "h"), (1, text, "h")], "doc_id long, text string, source string")
    assert [r.kept for r in L.line_rules(df).collect()] == [True] * 3
    assert L.apply_line_rules(df).count() == 3
    assert L.line_rules(df.limit(0)).count() == 0 and L.apply_line_rules(df.limit(0)).count() == 0
