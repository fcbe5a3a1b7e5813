"""Tables in the folder that all executors share, to cut a long lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), f'heronry-{os.getpid()}')}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/heronry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
