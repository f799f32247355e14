"""Keeping costly columns from being computed twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with ``columns`` fixed at this point of the plan.

    The optimizer moves a filter on a computed column below the projection that
    computes it, by repeating the expression inside the filter; exploding an array
    adds such a filter, too. For a scan of forty patterns that doubles the work.
    A one-element generator over the finished columns is a step no filter on them
    can pass, while filters on all other columns still go through.
    """
    fixed = F.inline(F.array(F.struct(*[F.col(c) for c in columns])))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, fixed.alias(*columns)).select(*df.columns)


def owners(narrow: DataFrame, key: str, row_keys: Sequence[str]) -> DataFrame:
    """The first row by ``row_keys`` for each ``key``; reads and moves these columns only."""
    return narrow.groupBy(key).agg(F.min(F.struct(*row_keys)).alias("_o")).select(
        key, *[F.col(f"_o.{c}") for c in row_keys]
    )


def rows_of(df: DataFrame, owned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose ``keys``, nulls included, are in ``owned``: a semi-join.

    With ``owners``, wide columns such as texts are fetched for the chosen rows alone and
    take part in no aggregate; where the owners are small, they do not move at all.
    """
    wanted = owned.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(keys)])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return df.join(wanted, same, "left_semi")
