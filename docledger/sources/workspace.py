"""Where jobs keep what must outlive one executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh one in local mode only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return folder
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="docledger-")
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark).rstrip('/')}/docledger/{label}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once under the shared folder and read it from there.

    Used where several results must come from the same rows: the work is done
    once, and a lost executor cannot make the results disagree.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
