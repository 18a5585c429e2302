"""Cutting lineage where a plan is read many times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what the session checkpoints to.

    Where neither is set a local session, which has one machine only, gets a temporary one; a cluster raises RuntimeError.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="barflow-checkpoint-")
        context.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder.

    Iterative fits read their input dozens of times: without this each reading would compute the features again.
    """
    shared_root(df.sparkSession)
    return df.checkpoint()
