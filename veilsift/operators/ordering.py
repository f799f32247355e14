"""Running offsets over an ordered run, without gathering a run in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def with_offsets(
    df: DataFrame,
    run_keys: Sequence[str],
    index_col: str,
    size_col: str,
    out_col: str = "offset",
    block: int = BLOCK,
) -> DataFrame:
    """Add the sum of ``size_col`` over all earlier rows of the same run.

    A window over a whole run would put a run that holds a third of all rows
    into one task. Here rows fall into blocks of ``block`` consecutive indexes
    and blocks into super-blocks; each window sees one block's rows or one
    super-block's blocks, and the top window one row per super-block
    (``block`` squared indexes). Indexes are non-negative integers, increasing
    in run order. ``df`` is read three times: pass a frame that is cheap to read.
    """
    runs = list(run_keys)
    b1 = F.floor(F.col(index_col) / block).cast("long")
    placed = df.withColumn("_b1", b1)

    def before(total: str, partition: list[str], order: str):
        w = Window.partitionBy(*partition).orderBy(order)
        return F.coalesce(
            F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )

    blocks = (
        placed.groupBy(*runs, "_b1").agg(F.sum(size_col).alias("_n"))
        .withColumn("_b2", F.floor(F.col("_b1") / block).cast("long"))
    )
    supers = blocks.groupBy(*runs, "_b2").agg(F.sum("_n").alias("_n"))
    supers = supers.withColumn("_o2", before("_n", runs, "_b2")).drop("_n")
    offsets = (
        blocks.withColumn("_o1", before("_n", [*runs, "_b2"], "_b1"))
        .drop("_n")
        .join(supers, [*runs, "_b2"])
        .select(*runs, "_b1", (F.col("_o1") + F.col("_o2")).alias("_o"))
    )
    local = placed.withColumn("_o0", before(size_col, [*runs, "_b1"], index_col))
    return (
        local.join(offsets, [*runs, "_b1"])
        .withColumn(out_col, (F.col("_o") + F.col("_o0")).cast("long"))
        .drop("_b1", "_o", "_o0")
    )
