"""Materialisation in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> None:
    """Set a checkpoint folder where the session has none. A cluster must name one in spark.checkpoint.dir; a local session gets its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandlake-"))


def stored(df: DataFrame) -> DataFrame:
    """The frame's rows written to the shared folder and read from there: lineage ends here and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame's rows as a Parquet table in the shared folder, with the same columns."""
    shared_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
