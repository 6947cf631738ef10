"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget how it was made.

    The folder is the one that the session names in spark.checkpoint.dir. Only a session
    without one (a test on a single machine) gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="processgraph-"))
    return df.checkpoint(eager=True)
