"""Cutting a lineage into the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the session's `spark.checkpoint.dir` and go on from there. Only a local master (tests) may leave
    it unset: there a temporary folder is used; on a cluster that would be another disk on every node."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "aerolith-checkpoints"))
    return df.checkpoint(eager=True)
