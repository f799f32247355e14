"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. Its result is written as
Parquet to the shared scratch folder and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilsift.llm.arrowtext import unused_name
from veilsift.llm.bpe import encode_bpe
from veilsift.llm.decontaminate import with_leaks
from veilsift.llm.language_id import MIN_CLARITY, UNKNOWN, fit_on_documents, identify_languages
from veilsift.llm.line_rules import apply_line_rules
from veilsift.llm.near_dup import drop_near_duplicates
from veilsift.llm.queries import found_by_workers
from veilsift.session import scratch_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can't express the language model, the signatures or the merges of the stages.
ORACLE_SQL = None


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages the labels name; texts without letters, or of words in no clear language, go.

    A text may mix languages, as long as its words are clear. Null and empty texts go. ``lang``
    is set to the prediction where it was null. Repeated rows are kept or go together.
    """
    lang, score, clarity = (unused_name(docs, n) for n in ("_lang", "_score", "_clarity"))
    rows = identify_languages(
        docs, fit_on_documents(docs), lang_col=lang, score_col=score, clarity_col=clarity
    )
    clear = rows.where((F.col(lang) != UNKNOWN) & (F.col(clarity) >= MIN_CLARITY))
    return _same_columns(clear.withColumn("lang", F.coalesce("lang", lang)), docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the base rules and are not depleted, without the lines their host repeats.

    Null and empty texts go. Repeated rows count as one document and stay repeated.
    """
    rows = apply_line_rules(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.length("text").cast(kind))
    return _same_columns(rows, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least id.

    Null and empty texts are kept as they are. Of repeated rows one stays.
    """
    return _same_columns(drop_near_duplicates(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item; null and empty texts cover none. Repeated rows stay or go together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = unused_name(docs, "_leaks")
    return _same_columns(with_leaks(docs, benchmark, out_col=leaks).where(F.size(leaks) == 0), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids (32-bit, little-endian), their number, digests of ids and decoded text.

    Null and empty texts have no tokens. Repeated rows give repeated results.
    """
    return encode_bpe(docs.select("doc_id", "text"), decoded_col="decoded").select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("quality", quality), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    found_by_workers(spark)
    folder = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
