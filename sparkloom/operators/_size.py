"""Broadcasts behind a check of size."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 100_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints")
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed below spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_dir(df.sparkSession))
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and read again, a column at a time."""
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
