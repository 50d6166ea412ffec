"""A folder that driver and executors share, and tables written there."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or else a folder in its warehouse."""
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return spark.conf.get("spark.checkpoint.dir", own).rstrip("/")


@dataclass(frozen=True)
class Written:
    """A table in the shared folder; lost executors don't lose it."""

    frame: DataFrame
    path: str
    name: str | None = None

    def drop(self) -> None:
        """Deletes the table's files."""
        spark = self.frame.sparkSession
        if self.name:
            spark.sql(f"drop table if exists {self.name}")
        java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        java.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(java, True)


def write(frame: DataFrame) -> Written:
    """frame as Parquet in the shared folder."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return Written(spark.read.schema(frame.schema).parquet(path), path)


def write_bucketed(frame: DataFrame, keys: list[str], buckets: int) -> Written:
    """frame as a table in buckets of keys: a join on them moves the other side only."""
    spark = frame.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    frame.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return Written(spark.table(name), path, name)
