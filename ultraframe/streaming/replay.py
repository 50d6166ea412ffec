"""A table as a stream of files that arrive out of order, and a stream as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import shared_folder

#: Rows of a batch that one file holds, at most about.
ROWS = 250_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(frame: DataFrame, time: str, key: Column, late_s: int, files: int, closing: dict[str, Column], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What stream makes of frame when its rows arrive by time, each up to late_s seconds late by its key, in so many batches.

    A batch is a number of files that grows with the rows, the same for all
    batches.  A last one holds one row, frame's columns as closing has them and
    others null, to let the watermark pass all others; its time must be far off.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 + F.pmod(F.xxhash64(key), F.lit(late_s))
    timed = frame.withColumn("_arrival", seconds)
    ends = timed.agg(F.min("_arrival").alias("low"), F.max("_arrival").alias("high")).first()
    part = F.floor((F.col("_arrival") - ends.low) / max(ends.high - ends.low, 1e-9) * files * 0.999999) if ends.low is not None else F.lit(0)
    timed.withColumn("_file", part).drop("_arrival").write.partitionBy("_file").parquet(f"{folder}/all")
    rows = spark.read.parquet(f"{folder}/all")
    counts = {r["_file"]: r["count"] for r in rows.groupBy("_file").count().collect()}  # a row for each batch
    # No file of a batch may be empty, for that one would not be written: the smallest batch sets how many.
    split = max(1, min(counts.get(i, 0) for i in range(files)) // ROWS)
    for i in range(files):
        own = rows.where(F.col("_file") == i).drop("_file")
        (own.repartition(split) if split > 1 else own.coalesce(1)).write.parquet(f"{folder}/in/{i:04d}")
    last = spark.range(1).select(*[closing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in frame.schema])
    last.write.parquet(f"{folder}/in/{files:04d}")
    # Files are taken in the order they were written in.
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", split).parquet(f"{folder}/in/*")
    found = stream(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(found.schema).parquet(f"{folder}/out")
