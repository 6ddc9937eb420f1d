"""Lineage cuts in the session's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, and read back from the folder in ``spark.checkpoint.dir``; only a local session may leave that unset."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/checkpoints")
    return df.checkpoint()
