"""Quality rules (operator 5): base counts, and lines that many documents of a host share.

DataFrame functions only: no Python runs on executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilsift.operators.joins import join_unique
from veilsift.session import scratch_root

#: Characters that count as symbols. A fixed value of the query's contract.
SYMBOLS = "#*$%&|<>"
#: White space between words, as a character class and as characters. Fixed values of the contract.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 10
MIN_LEFT = 0.3


def words_of(text: Column) -> Column:
    """Words of a text, between runs of white space."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_line_count(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda l: without(l, GAP_CHARS) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def window_starts(words: Column) -> Column:
    """Three-word windows as (hash, place), sorted, so that equal windows are neighbours."""
    n = F.size(words)
    windows = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(
            F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
        ),
    )
    return F.sort_array(windows)


def repeated_places(windows: Column) -> Column:
    """Places, in order, of windows that are found twice or more."""
    same = lambda w, k: F.coalesce(w["h"] == F.get(windows, k)["h"], F.lit(False))
    again = F.filter(windows, lambda w, k: same(w, k - 1) | same(w, k + 1))
    return F.sort_array(F.transform(again, lambda w: w["i"]))


def covered_words(places: Column) -> Column:
    """Words that windows of three at the given sorted places cover together."""
    each = F.transform(
        places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(3)), F.lit(3))
    )
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def line_hashes(text: Column) -> Column:
    """A hash of each line's normal form: lower case, letters and digits with single spaces
    between; null for a line with none of them."""
    def normal(line: Column) -> Column:
        form = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
        return F.when(form != "", F.xxhash64(form))

    return F.transform(F.split(text, "\n"), normal)


def measured(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One narrow row per document: base counts, and hash and words of each of its lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text")
    )
    split = rows.select("*", words_of(F.col("text")).alias("words"))
    windowed = split.select(
        "doc_id", "host", "text", F.size("words").cast("long").alias("n_words"),
        window_starts(F.col("words")).alias("windows"),
    )
    placed = windowed.select(
        "doc_id", "host", "text", "n_words", repeated_places(F.col("windows")).alias("places")
    )
    return placed.select(
        "doc_id", "host", "n_words",
        F.length(without(F.col("text"), GAP_CHARS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        repeated_line_count(F.col("text")).cast("long").alias("n_dup_lines"),
        covered_words(F.col("places")).cast("long").alias("n_repeat_words"),
        line_hashes(F.col("text")).alias("line_hashes"),
        F.transform(F.split("text", "\n"), lambda l: F.size(words_of(l))).alias("line_words"),
        F.xxhash64("text").alias("text_hash"), _key(F.col("doc_id")).alias("id_key"),
        _key(F.col("host")).alias("host_key"),
    )


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("\0null"))


def shared_lines(documents: DataFrame, min_docs: int) -> DataFrame:
    """Lines above the limit: ``host_key``, ``line``.

    A line counts once for each document, by its id. Both steps have partial aggregates, and
    the first spreads a line of half of all documents over these.
    """
    lines = documents.select(
        "host_key", "id_key", F.explode(F.array_distinct(F.array_compact("line_hashes"))).alias("line")
    )
    return lines.distinct().groupBy("host_key", "line").agg(F.count("*").alias("n")).where(
        F.col("n") > min_docs
    ).select("host_key", "line")


def line_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT,
) -> DataFrame:
    """Verdicts, one row per input row: base counts, ``base_failed``, ``removed`` (numbers of
    the lines to take out, from 0), ``left_words`` and ``kept``, with ``id_key``, ``text_hash``
    and ``host_key``, which name the row.

    A line is above the limit if, in its normal form, it stands in more than ``min_docs``
    documents of its host, whatever the host's size. A document is kept if the base rules
    hold and at least the share ``min_left`` of its words is left without such lines.

    Texts are read once, in a narrow step; what is shuffled are line hashes, never text.
    A line of half of all documents is counted by partial sums, and the join that finds
    it again is split by adaptive execution.

    Null text is empty: no words, base_failed. Null hosts are one host, and rows without an id
    one document. Repeated rows count as one document and get equal verdicts; one id in two
    hosts is a document of each. An empty table gives an empty one. Other columns are not read.
    """
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    measured(df, id_col, text_col, host_col).write.parquet(path)
    documents = df.sparkSession.read.parquet(path)
    shared = shared_lines(documents, min_docs)
    row = ["id_key", "text_hash", "host_key"]
    lines = documents.select(
        *row, F.posexplode("line_hashes").alias("number", "line")
    ).where("line is not null")
    removed = join_unique(lines, shared, ["host_key", "line"], "inner").groupBy(*row).agg(
        F.sort_array(F.collect_set("number")).alias("removed")
    )
    rows = join_unique(documents, removed, row)
    lost = F.aggregate(
        F.coalesce("removed", F.array().cast("array<int>")), F.lit(0),
        lambda total, k: total + F.get("line_words", k),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return rows.withColumn("left_words", (F.col("n_words") - lost).cast("long")).withColumn(
        "base_failed", failed
    ).withColumn(
        "kept", ~F.col("base_failed") & (F.col("left_words") >= min_left * F.col("n_words"))
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "left_words", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        "kept", *row,
    )


def without_lines(text: Column, removed: Column) -> Column:
    """A text without the lines whose sorted numbers are given, in time linear in its lines."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    ends = F.concat(removed, F.array(n))
    stretches = F.transform(
        ends, lambda end, k: F.slice(
            lines, F.coalesce(F.get(removed, k - 1) + 2, F.lit(1)),
            end - F.coalesce(F.get(removed, k - 1) + 1, F.lit(0)),
        )
    )
    return F.array_join(F.flatten(stretches), "\n")


def apply_line_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options
) -> DataFrame:
    """The kept rows of ``df``, all columns, their text without the lines above the limit.

    Rows with null or empty text go, as they fail the base rules. Repeated rows stay repeated.
    An empty table gives an empty one.
    """
    row = ["id_key", "text_hash", "host_key"]
    verdicts = line_rules(df, id_col, text_col, host_col, **options).where("kept").groupBy(*row).agg(
        F.first("removed").alias("removed")
    )
    keyed = df.select(
        F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), _key(F.col(id_col)).alias("id_key"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"),
        _key(F.col(host_col)).alias("host_key"),
    )
    rows = join_unique(keyed, verdicts, row, "inner")
    text = F.col("row")[text_col]
    cut = F.when(F.size("removed") > 0, without_lines(text, F.col("removed"))).otherwise(text)
    return rows.select(*[(cut if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


def op5_line_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return line_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "left_words",
    )


OP5_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM docs),
windows AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM words)
),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows),
gaps AS (SELECT rid, lead(i) OVER (PARTITION BY rid ORDER BY i) - i AS gap FROM again WHERE n > 1),
repeats AS (SELECT rid, sum(least(coalesce(gap, 3), 3)) AS n FROM gaps GROUP BY rid),
cut AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (
  SELECT rid, coalesce(CAST(doc_id AS VARCHAR), 'none') AS id_key, source, line,
    trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS form,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM cut
),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY rid),
shared AS (
  SELECT source, form FROM lines WHERE form <> '' GROUP BY source, form
  HAVING count(DISTINCT id_key) > {MIN_DOCS}
),
lost AS (
  SELECT l.rid, sum(l.n) AS n FROM lines l JOIN shared s
  ON l.source IS NOT DISTINCT FROM s.source AND l.form = s.form GROUP BY l.rid
),
rated AS (
  SELECT w.doc_id, len(w.ws) AS n_words,
    length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(w.text) - length(translate(w.text, '{SYMBOLS}', '')) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(w.ws) - coalesce(l.n, 0) AS BIGINT) AS left_words
  FROM words w LEFT JOIN dups d USING (rid) LEFT JOIN repeats r USING (rid) LEFT JOIN lost l USING (rid)
),
failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM rated
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words,
  NOT base_failed AND left_words >= {MIN_LEFT} * n_words AS kept
FROM failed
"""
