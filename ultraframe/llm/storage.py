"""Checkpoints in the folder that driver and executors share, and columns by their exact names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exact(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def prepare(spark: SparkSession) -> None:
    """Sets a checkpoint folder where the session has none: spark.checkpoint.dir, or else one beside the warehouse."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", own))


def saved(frame: DataFrame) -> DataFrame:
    """frame, computed and written now; lost executors don't lose it."""
    prepare(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """frame as Parquet in the checkpoint folder, read again."""
    spark = frame.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.parquet(path)
