"""Activity over a stream of events (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp, with a watermark where the events are a stream."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", late) if events.isStreaming else own


def windowed_share(events: DataFrame, playing: float, active: float, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n_play, share: of the events of a window whose value exceeds playing, those that exceed active.

    The same expression over a batch gives the same rows; over a stream the
    watermark bounds the state.
    """
    own = _timed(events, late)
    plays, both = F.count_if(F.col("value") > playing), F.count_if(F.col("value") > active)
    out = own.groupBy(F.window("ts", length, slide or length).alias("w"), "event_type").agg(plays.alias("n_play"), (both / F.nullif(plays, F.lit(0))).alias("share"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n_play", "share")


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n of runs of events with no pause of gap."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
