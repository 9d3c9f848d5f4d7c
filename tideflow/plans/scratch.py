"""Scratch tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Scratch tables that this process has written and not yet deleted.
_WRITTEN: list[str] = []


def scratch_path(df: DataFrame, keep: bool = False) -> str:
    """A new path in the shared checkpoint folder, which clear_scratch deletes if it is to keep it in mind; only where that is unset and everything runs in one process (tests), in the machine's temp folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/flow-{uuid.uuid4().hex}"
    if keep:
        _WRITTEN.append(path)
    return path


def written(df: DataFrame, *folders: str) -> DataFrame:
    """Write and read back: the lineage ends here, and a lost executor loses nothing. folders: columns of which each value gets a folder of its own."""
    path = scratch_path(df, keep=True)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this process has written; for the end of a run, when no frame that reads them is used again. Returns how many there were."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
