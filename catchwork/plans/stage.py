"""Cutting lineage in the shared checkpoint folder, and checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at ``spark.checkpoint.dir``; a local session without one gets a folder of its own.

    A cluster session without the setting is refused: a machine-local folder there would lose
    data with the machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="catchwork-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, stored reliably; later reads survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only if the counted ``rows`` stay within ``most``; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df
