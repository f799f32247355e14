"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, chat, decontaminate, exact_topk, hard_negatives, language_id, license_scan, line_rules, lm_score, near_dup, periodic,
    token_counts, wavelet,
)

Query = Callable[[SparkSession, str], DataFrame]
ROOT = str(Path(__file__).resolve().parents[2])


def found_by_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is deployed like any other; an absent folder does no harm.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [*paths, ROOT] if p)


def _registered(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found_by_workers(spark)
        return query(spark, sf_dir)

    return run


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's rows."""
    import corpus_pipeline  # at the top of the repository; it imports this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: _registered(f) for f in (
        chat.op1_chat_format, lm_score.op2_lm_difference, language_id.op3_language_id, bpe.op4_bpe,
        line_rules.op5_line_rules, near_dup.op6_dart_minhash, license_scan.op7_license_scan,
        wavelet.op8_wavelet_shards, token_counts.op9_token_counts, decontaminate.op10_string_tiling,
        periodic.op11_periodic_runs, exact_topk.op12_exact_topk, hard_negatives.op13_hard_negatives, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op1_chat_format": chat.OP1_SQL, "op5_line_rules": line_rules.OP5_SQL,
    "op12_exact_topk": exact_topk.OP12_SQL, "op13_hard_negatives": hard_negatives.OP13_SQL,
}
