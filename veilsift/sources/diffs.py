"""Changed files and their diff text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import is_doc_file, path_risk, should_skip
from ..functions.text import content_hash, cut_diff, is_blank
from ..operators.joins import join_unique
from ..rules import CHANGE_TYPES
from ..schemas import FILE_DIFFS


def read_file_diffs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A ``file_diffs`` table from Parquet, JSON, ORC or CSV files."""
    return spark.read.schema(FILE_DIFFS).format(fmt).load(path)


def changed_files(df: DataFrame, run_keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Added, copied, modified, renamed and retyped files of each run.

    A run with any staged file keeps its staged files; a run with none keeps its
    working-tree files. The per-run test is an aggregate with map-side partials
    joined back, so a run of any size is never gathered in one task.
    """
    kept = df.where(F.col("change_type").isin(*CHANGE_TYPES))
    staged = (
        kept.groupBy(*run_keys)
        .agg(F.max("is_staged").alias("_any_staged"))
        .where("_any_staged")
        .select(*run_keys, "_any_staged")
    )
    return (
        join_unique(kept, staged, run_keys)
        .where(F.col("is_staged") | F.col("_any_staged").isNull())
        .drop("_any_staged")
    )


def pick_diff(df: DataFrame, staged_col: str, head_col: str, out_col: str = "diff") -> DataFrame:
    """The staged diff, or the diff against the last commit where that is blank."""
    staged, head = F.col(staged_col), F.col(head_col)
    return df.withColumn(
        out_col, F.coalesce(F.when(~is_blank(staged), staged), head, F.lit(""))
    )


def prepare_files(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Triage, cut, drop blank diffs, hash; add ``is_doc`` and ``path_risk``.

    A ``diff_hash`` column already present is kept, so that narrow consumers do
    not read the text again; rows that carry one are taken as not blank.
    """
    path = F.col("file_path")
    out = df.where(~should_skip(path)).withColumn("diff", cut_diff(F.col("diff"), max_chars))
    if "diff_hash" not in df.columns:
        out = out.where(~is_blank(F.col("diff"))).withColumn("diff_hash", content_hash(F.col("diff")))
    return out.withColumns({"is_doc": is_doc_file(path), "path_risk": path_risk(path)})
