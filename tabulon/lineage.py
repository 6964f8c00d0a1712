"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    The cluster names it in `spark.checkpoint.dir`. Only a local session without that setting gets
    a temporary folder; on a cluster its absence is an error, as a machine-local folder would lose data.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    path = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tabulon-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: written once to the shared folder, so that a lost executor costs a reread only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
