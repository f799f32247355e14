"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    ``spark.checkpoint.dir`` names it on a cluster. Only where it is unset, as in
    local tests, a temporary folder stands in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="veilsift-")


def written_once(df: DataFrame) -> DataFrame:
    """A frame with several consumers, computed once and written to the checkpoint folder.

    Starts a job. The copy is a reliable checkpoint: consumers do not depend on the
    executors that computed it, and its lineage is cut.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()
