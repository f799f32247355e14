"""Joins to a side with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKET = "_vs_bucket"


def join_unique(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "left"
) -> DataFrame:
    """Join rows to a side that is unique on ``keys``; hot keys on the left may be huge.

    No broadcast is forced: Spark broadcasts a right side it measures as small. For
    the rest, adaptive execution splits a hot key's rows over tasks, but only when
    both sides come straight from a shuffle. A right side that was just aggregated
    by the same keys does not, since Spark sees it is partitioned already. The
    bucket, a function of the keys, is one more join key: it changes no result and
    makes Spark shuffle the (small, unique) right side for this join.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    bucket = F.pmod(F.xxhash64(*names), F.lit(1024)).cast("int")
    return left.withColumn(_BUCKET, bucket).join(
        right.withColumn(_BUCKET, bucket), [_BUCKET, *names], how
    ).drop(_BUCKET)
