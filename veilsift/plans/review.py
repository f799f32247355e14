"""Outbound review: redact what is routed to a reviewer, call a scorer, read replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import review_prompt
from ..operators.once import owners, rows_of
from ..operators.redact import outbound_filter
from ..operators.rollup import RUN_KEYS
from ..operators.route import REVIEW
from ..rules import DEFAULT_RULES, Rule

Scorer = Callable[[pd.Series], pd.Series]


def review_requests(
    routed: DataFrame, mode: str = "redact", rules: Sequence[Rule] = DEFAULT_RULES,
    files: DataFrame | None = None, row_keys: Sequence[str] = (*RUN_KEYS, "file_idx"),
) -> DataFrame:
    """Outbound text per distinct diff among rows with ``route`` = review.

    The filter covers the diff; blocked diffs get no request and so keep their
    local result. The file a diff is sent for, the first path, is chosen without its text,
    which is then fetched by ``row_keys`` (as far as both tables have them) from ``files``, by
    default the routed rows themselves. A file given twice asks twice.
    """
    files = routed if files is None else files
    keys = ["file_path", *(c for c in row_keys if c in routed.columns and c in files.columns)]
    asked = owners(routed.where(F.col("route") == REVIEW).select("diff_hash", *keys), "diff_hash", keys)
    one = rows_of(files, asked, ["diff_hash", *keys]).select("diff_hash", "file_path", "diff")
    filtered = outbound_filter(one, "diff", mode, rules)
    return filtered.where(F.col("outbound_status") != "blocked").select(
        "diff_hash",
        review_prompt(F.col("file_path"), F.col("outbound_text")).alias("request_text"),
        "outbound_status",
        "outbound_rules",
    )


def score_requests(requests: DataFrame, scorer: Scorer) -> DataFrame:
    """Verdict rows ``(diff_hash, response, error)`` from a caller's batch function.

    ``scorer`` maps a series of request texts to a series of replies, null where
    it has none. It runs in Arrow batches on the executors. Where it raises or gives a
    wrong number of replies, the batch is halved until the failing requests stand alone:
    these have an ``error`` and no response, and so keep their local result.
    """

    # local, so that workers need nothing but the caller's function
    def scored(texts: pd.Series) -> list[tuple[str | None, str | None]]:
        if texts.empty:
            return []
        try:
            replies = list(scorer(texts.reset_index(drop=True)))
            if len(replies) != len(texts):
                raise ValueError(f"{len(replies)} replies to {len(texts)} requests")
            return [(None if pd.isna(r) else r, None) for r in replies]
        except Exception as e:  # whatever a caller's function raises must not end the job
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return scored(texts.iloc[:half]) + scored(texts.iloc[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = scored(batch["request_text"])
            yield pd.DataFrame({
                "diff_hash": batch["diff_hash"].to_numpy(),
                "response": [r for r, _ in each], "error": [e for _, e in each],
            })

    return (
        requests.select("diff_hash", "request_text")
        .mapInPandas(run, "diff_hash string, response string, error string")
        .where(F.col("response").isNotNull() | F.col("error").isNotNull())
    )
