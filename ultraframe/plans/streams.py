"""Queries over streams of several files that arrive out of order, with the SQL of the same over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T
from ..streaming.activity import bursts
from ..streaming.best import running_best
from ..streaming.replay import replay
from . import oracles as O

FILES, FAR = 12, "2200-01-01"
DAYS, HOURS = 45, 6


def stream_best(spark: SparkSession, sf: str) -> DataFrame:
    """best_checkpoint over a stream whose rows arrive up to 45 days late."""
    by_day = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("bigint").alias("run"), F.to_timestamp("o_orderdate").alias("epoch")).agg((F.max("o_totalprice") / 1e6).alias("accuracy"))
    closing = {"run": F.lit(-1), "epoch": F.lit(FAR), "accuracy": F.lit(0.0)}
    found = replay(by_day, "epoch", F.struct("run", "epoch"), DAYS * 86400, FILES, closing, lambda s: running_best(s, f"{DAYS + 1} days"))
    return found.where("run >= 0").select("run", F.date_format("epoch", "yyyy-MM-dd").alias("epoch"), "saved")


def stream_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """event_bursts over a stream whose rows arrive up to six hours late."""
    events = T.table(spark, sf, "events").select("user_id", "ts", "event_id")
    closing = {"user_id": F.lit(-1), "ts": F.lit(FAR), "event_id": F.lit(-1)}
    found = replay(events, "ts", F.col("event_id"), HOURS * 3600, FILES, closing, lambda s: bursts(s, late=f"{HOURS + 1} hours"))
    return found.where("user_id >= 0").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


QUERIES = {f.__name__: f for f in (stream_best, stream_bursts)}
SQL = {"stream_best": O.SQL["best_checkpoint"], "stream_bursts": O.SQL["event_bursts"]}
