"""Where lineage ends."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no shared folder and runs in one process (tests).
LOCAL_FOLDER = "file:///tmp/checkpoints/framelytics"


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the folder of spark.checkpoint.dir, which driver and executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_FOLDER)
    return df.checkpoint()
