"""Input views derived from the driver tables, in Spark and as DuckDB SQL.

Planted lines are kept in pieces so that no file here holds a secret-shaped
string; all values are invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.functions import content_hash
from veilsift.rules import DEFAULT_RULES

_PIECES = (
    # 0-42: one line per rule, in rule order
    ('k = "sk', "-", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1", '"'),
    ("id = AK", "IA", "QZ7LM2XV9RT4KP8W"),
    ("-----BEGIN RSA ", "PRIVATE KEY-----"),
    ("db = pg:", "//svc:", "Zk93xq@db1.acme.net/x"),
    ("t = gh", "p_", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1Fc5G"),
    ('console.log("x", passwd)',),
    ("console.info(user.address)",),
    ("console.log(`u ", "$", "{row.phone}`)"),
    ("save({ password: req.body.password })",),
    ("navigator.geolocation.watchPosition(cb)",),
    ('fetch("http:', '//api.acme.net/v1")'),
    ('axios.post("http:', '//api.acme.net/v1")'),
    ('gtag("event", "x")',),
    ('mixpanel.track("x")',),
    ('amplitude.logEvent("x")',),
    ('analytics.track("x")',),
    ("m = ann.lee", "@acme.net"),
    ("p = 415-", "867-5309"),
    ("s = 519-", "84-2277"),
    ('dob = "4/17/1988"',),
    ('passport: "K0482917"',),
    ("loc = 48.8566, 2.3522",),
    ("a = 742 Maple Grove Ave",),
    ('passwd = "', 'Zk93xqWv7p"'),
    ("u?si", "g=", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1Fc5Gs0Ja"),
    ("aws_secret_", "access_key=", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1Fc5Gs0Ja", "Bq4Tn7Ru"),
    ("g = AI", "za", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1Fc5Gs0Ja", "x9Q"),
    ("j = ey", "J", "Qz7Lm2Xv9Rt4", ".ey", "J", "Kp8Wn3Hd6Yb1", ".", "Qz7Lm2Xv9R"),
    ("-----BEGIN OPENSSH ", "PRIVATE KEY-----"),
    ("Authorization: Bea", "rer ", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1Fc5Gs0Ja"),
    ('aes_key = "', '9f3a71c04be82d65aa17"'),
    ("h = 10.", "24.7.19"),
    ("u = localhost:", "8080"),
    ("u = https:", "//staging.acme.net/x"),
    ("w = https:", "//hooks.acme.net/webhook/", "Qz7Lm2Xv9Rt4Kp8W"),
    ("# TODO rotate credential",),
    ("// token = ", "zz91"),
    ("ref invoice #", "AB-20417"),
    ("// trade secret",),
    ("license_key = ", "QZ7L-M2XV-9RT4"),
    ("mrn = ", "8841207"),
    ('diagnosis = "', 'E119"'),
    ("NPI: ", "1730482956"),
    # 43-49: edge cases
    ("m = user", "@example.com"),
    ('k = "sk', "-", "a" * 20, '"'),
    ("x = process.env.MAIL // ann.lee", "@acme.net"),
    ("clean line",),
    ("console.log(", "\n+", "  user.address)"),
    ("m = user", "@example.com", "\n+", "m = ann.lee", "@acme.net"),
    ('passwd = "sk', "-", "Qz7Lm2Xv9Rt4Kp8Wn3Hd6Yb1", '"'),
)
PLANTED = tuple("".join(p) for p in _PIECES)
REMOVED_46 = "".join(("s = 519-", "84-2277"))

DIRS = ("src/auth/", "src/utils/", "notes/", "src/app/", "payments/", "test/fixtures/",
        "assets/", "lib/core/")
EXTENSIONS = (".ts", ".js", ".md", ".py", ".png", ".min.js", ".lock")
CHANGES = ("A", "M", "R", "M", "C", "D", "T", "M", "X")


TEXT_TABLES = ("documents", "conversations", "pages")

def spread_rows(df: DataFrame) -> DataFrame:
    """Text from a source with fewer splits than cores, spread over all cores.

    Scanning text is heavy per byte, and one small file is one task. A source with
    at least as many splits as cores, so any large table, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_rows(df) if name in TEXT_TABLES else df


def _pick(values: tuple[str, ...], key: Column) -> Column:
    """One of a few fixed texts by a key."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _diff_text(path: Column, key: Column, text: Column) -> Column:
    nl = F.lit("\n")
    removed = F.when(key % 50 == 46, F.lit(REMOVED_46)).otherwise(F.lit("unused"))
    return F.concat(
        F.lit("+++ b/"), path, nl, F.lit("-"), removed, nl,
        F.lit("+"), _pick(PLANTED, key), nl,
        F.lit("+"), F.replace(text, nl, F.lit("\n+")),
    )


def file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_diffs_of(table(spark, sf_dir, "documents"))


def file_diffs_of(documents: DataFrame) -> DataFrame:
    """One changed file per document; its text is what the file adds."""
    key = F.col("doc_id")
    path = F.concat(
        _pick(DIRS, key), F.lit("f"), key.cast("string"), _pick(EXTENSIONS, key)
    )
    repo = (key % 20).cast("int")
    return documents.select(
        repo.alias("repo_id"),
        (key % 100).cast("int").alias("commit_no"),
        key.alias("file_idx"),
        path.alias("file_path"),
        _pick(CHANGES, key).alias("change_type"),
        ((repo % 3 != 0) & (key % 4 != 0)).alias("is_staged"),
        "lang",
        _diff_text(path, key, F.col("text")).alias("diff"),
    )


def copied_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs without a per-file header, so copied documents give equal diffs."""
    key = F.col("doc_id")
    path = F.concat(
        _pick(DIRS, key), F.lit("f"), key.cast("string"), _pick(EXTENSIONS, key)
    )
    return table(spark, sf_dir, "documents").select(
        F.lit(1).alias("repo_id"),
        F.when(F.col("lang") == "en", F.lit(1)).otherwise(F.lit(2)).alias("commit_no"),
        key.alias("file_idx"),
        path.alias("file_path"),
        "lang", F.length("text").alias("text_chars"),
        _diff_text(F.lit("file"), F.length("text"), F.col("text")).alias("diff"),
    )


def with_planted(df: DataFrame, text: str, key: Column) -> DataFrame:
    """The table with one of the planted lines behind each text, and the same line once more
    on a line that reads from configuration."""
    planted = _pick(PLANTED, key)
    return df.withColumn(
        text, F.concat(F.col(text), F.lit("\n"), planted, F.lit("\nrun(process.env.STAGE) // "), planted)
    )


NEW_ISSUE = "Free-text note kept without an expiry date."


def verdicts(diffs: DataFrame, key: Column) -> DataFrame:
    """Reviewer replies for all diffs: plain JSON, fenced JSON, or cut-off JSON by key.

    Each names the issue text of one rule and one new issue.
    """
    issue_texts = tuple(r.issue for r in DEFAULT_RULES)
    reply = F.to_json(F.struct(
        F.lit("HIGH").alias("overall_risk"),
        F.concat(F.lit("Reviewed case "), (key % 50).cast("string")).alias("summary"),
        F.array(
            F.struct(
                F.lit("m.ts").alias("file"), F.lit("hint").alias("line_hint"),
                F.lit("MEDIUM").alias("severity"), _pick(issue_texts, key % 50).alias("issue"),
                F.lit("fix it").alias("fix"), F.lit("none").alias("regulation"),
            ),
            F.struct(
                F.lit("m.ts").alias("file"), F.lit("note").alias("line_hint"),
                F.when(key % 2 == 0, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"),
                F.lit(NEW_ISSUE).alias("issue"), F.lit("Set a retention period.").alias("fix"),
                F.lit("none").alias("regulation"),
            ),
        ).alias("issues"),
    ))
    response = (
        F.when(key % 3 == 0, reply)
        .when(key % 3 == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```\n")))
        .otherwise(F.lit('{"overall_risk": "HIGH", "issues": ['))
    )
    # every third diff has a cut-off copy of its reply, too
    replies = F.when(key % 3 == 0, F.array(F.substring(response, 1, 40), response)).otherwise(F.array(response))
    return diffs.select(
        content_hash(F.col("diff")).alias("diff_hash"), F.explode(replies).alias("response")
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package per fifty parts, so packages grow with the part table."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.floor(F.col("p_partkey") / 50).cast("int").alias("n"))
        .agg(F.min("p_name").alias("about"), F.min("p_size").alias("size"))
    )


def _name(n: Column) -> Column:
    return F.concat(F.lit("pkg"), n.cast("string"))


def policy_url(n: Column) -> Column:
    return F.concat(F.lit("https://"), _name(n), F.lit(".acme.net/privacy"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per order: odd lines are runtime, even lines development dependencies."""
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("manifest_id"),
            (F.col("l_linenumber") % 2 == 0).alias("dev"),
            _name(F.floor(F.col("l_partkey") / 50)).alias("key"),
        )
        .agg(F.max("l_linenumber").alias("line"))
        .withColumn("value", F.concat(F.lit("1."), F.col("line").cast("string"), F.lit(".0")))
    )

    def as_map(of: Column) -> Column:
        return F.map_from_entries(F.array_sort(
            F.collect_list(F.when(of, F.struct("key", "value")))
        ))

    return items.groupBy("manifest_id").agg(
        as_map(~F.col("dev")).alias("dependencies"),
        as_map(F.col("dev")).alias("devDependencies"),
    )


def reference_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown reference documents of up to ten packages each."""
    n = F.col("n")
    number = n.cast("string")
    retired = n % 10 == 9

    def line(label: str, value: Column, when: Column) -> Column:
        return F.when(when, F.concat(F.lit(f"- **{label}**: "), value, F.lit("\n"))).otherwise("")

    entry = F.concat(
        F.lit("### "), number, F.lit(". **"), _name(n), F.lit("**"),
        F.when(retired, F.lit(" (Deprecated)")).otherwise(""), F.lit("\n"),
        F.col("about"), F.lit("\n"),
        line("npm", F.concat(F.lit("https://npm.acme.net/"), _name(n)), F.lit(True)),
        line("Security Policy", F.concat(F.lit("https://sec.acme.net/"), number), n % 2 == 0),
        line("Privacy Policy", policy_url(n), n % 3 == 0),
        line("Note", F.lit("Unmaintained, look for `another`"), retired),
        line("GitHub", F.concat(F.lit("https://git.acme.net/"), number), F.lit(True)),
    )
    known = packages(spark, sf_dir).where(n % 8 != 7)
    grouped = known.groupBy(F.floor(n / 10).alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("n", entry.alias("entry")))).alias("entries")
    )
    return grouped.select(F.concat(
        F.lit("# Packages\n\nAbout this list.\n\n---\n\n## Group "), F.col("g").cast("string"),
        F.lit("\n\n"),
        F.array_join(F.transform("entries", lambda e: e.entry), "\n"),
        F.lit("\n---\n\n## Resources\n\n### Links\n- **Privacy Policy**: https://x.acme.net/p\n"),
    ).alias("text"))


def package_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring replies, one JSON array per ten packages, every second one fenced."""
    n = F.col("n")
    scores = ("SAFE", "CAUTION", "HIGH_RISK")
    verdict = F.struct(
        _name(n).alias("name"), F.lit("1.0.0").alias("version"), _pick(scores, n).alias("score"),
        F.concat(F.lit("About "), F.col("about")).alias("reason"),
        F.when(n % 3 == 2, F.concat(F.lit("alt-"), _name(n))).alias("alternative"),
        F.when(n % 2 == 0, F.lit("GDPR Article 6")).alias("regulation"),
        F.when(n % 4 == 0, policy_url(n)).alias("privacyPolicyUrl"),
    )
    # every fifth package has a verdict for one version, too
    later = verdict.withField("version", F.lit("1.3.0")).withField("score", F.lit("HIGH_RISK")).withField(
        "reason", F.concat(F.lit("Version of "), F.col("about"))
    )
    verdicts = F.when(n % 5 == 0, F.array(verdict, later)).otherwise(F.array(verdict))
    grouped = packages(spark, sf_dir).where(n % 7 != 6).select(
        F.floor(n / 10).alias("g"), F.explode(verdicts).alias("v")
    ).groupBy("g").agg(F.to_json(F.array_sort(F.collect_list("v"))).alias("json"))
    fenced = F.concat(F.lit("```json\n"), F.col("json"), F.lit("\n```"))
    return grouped.select(
        F.when(F.col("g") % 2 == 1, fenced).otherwise(F.col("json")).alias("response")
    )


def policy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report answers of five kinds: two body shapes, an error, bad JSON, no answer."""
    n = F.col("n")
    i_text = lambda i: i.cast("string")
    clauses = F.transform(
        F.slice(F.sequence(F.lit(1), F.lit(9)), F.lit(1), n % 9),
        lambda i: F.struct(
            F.when(i % 3 == 1, F.concat(F.lit("class "), i_text(i))).alias("classification"),
            F.when(i % 3 == 2, F.concat(F.lit("cat "), i_text(i))).alias("category"),
            F.when(i % 2 == 0, F.concat(F.lit("insight "), i_text(i))).alias("plain_insight"),
            F.when(i % 3 != 0, F.concat(F.lit("text "), i_text(i))).alias("text"),
            F.when(i == 4, F.lit("fine")).alias("fine_label"),
        ),
    )
    report = F.struct(
        F.concat(_name(n), F.lit(".acme.net")).alias("domain"),
        (F.col("size") + F.when(n % 2 == 0, 0.5).otherwise(0.0)).alias("score"),
        F.when(n % 4 != 3, _pick(("A", "B", "C"), n)).alias("grade"),
        F.lit("medium").alias("risk_level"),
        F.col("about").alias("summary"),
        F.create_map(
            F.lit("tracking"), (n % 6).cast("double"), F.lit("sharing"), F.lit(1.5)
        ).alias("risk_breakdown"),
        clauses.alias("clauses"),
    )
    failed = F.to_json(F.struct(F.lit("limit reached").alias("error")))
    kind = n % 5
    body = (
        F.when(kind == 0, F.to_json(report))
        .when(kind == 1, F.to_json(F.struct(report.alias("data"))))
        .when((kind == 2) & (n % 2 == 0), failed)
        .when(kind == 2, F.to_json(F.struct(F.lit("x").alias("summary"))))
        .when(kind == 3, F.lit('{"grade": "A"'))
    )
    answer = F.struct(
        F.when(kind == 2, 500).when(kind != 4, 200).alias("status_code"),
        body.alias("body"),
        F.when(kind == 4, F.when(n % 2 == 0, F.lit("timeout")).otherwise(F.lit("reset")))
        .alias("transport_error"),
    )
    late = F.struct(
        F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("body"),
        F.lit("timeout").alias("transport_error"),
    )
    # a report that was read once and timed out another time
    answers = F.when(kind < 2, F.array(late, answer)).otherwise(F.array(answer))
    return packages(spark, sf_dir).select(
        policy_url(n).alias("url"), F.explode(answers).alias("a")
    ).select("url", "a.*")


# -- the same views in DuckDB ------------------------------------------------

def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def _pick_sql(values: tuple[str, ...], key: str) -> str:
    return f"{_list(values)}[({key}) % {len(values)} + 1]"


def _diff_sql(path: str, key: str) -> str:
    return (
        f"'+++ b/' || {path} || chr(10) || '-' || "
        f"(CASE WHEN ({key}) % 50 = 46 THEN {quote(REMOVED_46)} ELSE 'unused' END) || chr(10) || "
        f"'+' || {_pick_sql(PLANTED, key)} || chr(10) || "
        f"'+' || replace(text, chr(10), chr(10) || '+')"
    )


_PATH_SQL = (
    f"({_pick_sql(DIRS, 'doc_id')} || 'f' || CAST(doc_id AS VARCHAR) || "
    f"{_pick_sql(EXTENSIONS, 'doc_id')})"
)

FILE_DIFFS_SQL = f"""
  SELECT CAST(doc_id % 20 AS INTEGER) AS repo_id, CAST(doc_id % 100 AS INTEGER) AS commit_no,
         doc_id AS file_idx, {_PATH_SQL} AS file_path,
         {_pick_sql(CHANGES, 'doc_id')} AS change_type,
         ((doc_id % 20) % 3 <> 0 AND doc_id % 4 <> 0) AS is_staged, lang,
         {_diff_sql(_PATH_SQL, 'doc_id')} AS diff
  FROM documents"""

COPIED_DIFFS_SQL = f"""
  SELECT 1 AS repo_id, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS commit_no,
         doc_id AS file_idx, {_PATH_SQL} AS file_path, lang,
         {_diff_sql("'file'", 'length(text)')} AS diff
  FROM documents"""

def with_planted_sql(source: str, text: str, key: str) -> str:
    planted = _pick_sql(PLANTED, key)
    return (
        f"SELECT * REPLACE ({text} || chr(10) || {planted} || chr(10) || 'run(process.env.STAGE) // ' "
        f"|| {planted} AS {text}) FROM {source}"
    )


PACKAGES_SQL = """
  SELECT CAST(p_partkey // 50 AS INTEGER) AS n, min(p_name) AS about, min(p_size) AS size
  FROM part GROUP BY 1"""


def policy_url_sql(n: str) -> str:
    return f"('https://pkg' || {n} || '.acme.net/privacy')"


DEPENDENCIES_SQL = """
  SELECT l_orderkey AS manifest_id, 'pkg' || (l_partkey // 50) AS name,
         l_linenumber % 2 = 0 AS is_dev, max(l_linenumber) AS line
  FROM lineitem GROUP BY ALL"""

# a development entry wins; runtime names keep their place before development-only ones
MERGED_SQL = """
  SELECT manifest_id, name, '1.' || arg_max(line, is_dev) || '.0' AS version,
         bool_or(is_dev) AS is_dev, bool_and(is_dev) AS dev_only
  FROM dependencies GROUP BY manifest_id, name"""
