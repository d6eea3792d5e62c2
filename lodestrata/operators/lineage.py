"""Cutting lineage where a frame is used more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df computed once, as a checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a local session gets a folder of its own; on a cluster it would be another one on each machine,
    so a session without the setting is refused.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()
