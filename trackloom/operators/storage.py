"""Where intermediate frames are kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoints(df: DataFrame) -> None:
    """The cluster's folder for checkpoints; only on one machine, as in tests, one of our own where none is named."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints")


def kept(df: DataFrame) -> DataFrame:
    """df computed once, written to that folder and read from there.

    Its columns get new identities: a checkpoint may carry constraints on columns that it no longer has, which a union of it cannot be planned with.
    """
    checkpoints(df)
    return df.checkpoint().select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def new_folder(df: DataFrame, name: str) -> str:
    """A path beside the checkpoints that no other run uses."""
    checkpoints(df)
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
