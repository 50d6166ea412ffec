"""Times, tags and runs written in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for an open time, and the tags of the two rates.
OPEN_TIMES = ("", "none", "all", "full", "end")
HIGH_TAG, LOW_TAGS = "96kHz", ("44kHz", "44.1kHz")
TIME_TAG = r"\((\d+)m(\d+)s_to_(\d+)m(\d+)s\)"


def parse_time(text: Column) -> Column:
    """Struct of seconds and valid: M:S, a number of seconds, or an open time (null seconds)."""
    t = F.lower(F.trim(text))
    parts = F.split(t, ":")
    minutes, seconds = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    open_time = t.isin(*OPEN_TIMES) | t.isNull()
    value = F.when(F.size(parts) == 1, t.try_cast("double")).when(F.size(parts) == 2, minutes * 60 + seconds)
    return F.struct(F.when(~open_time, value).alias("seconds"), (open_time | value.isNotNull()).alias("valid"))


def time_tag(name: Column) -> Column:
    """Struct of from_s and to_s of a tag (XmYs_to_AmBs) in a name; nulls without one."""
    part = lambda i: F.regexp_extract(name, TIME_TAG, i).try_cast("double")
    return F.struct((part(1) * 60 + part(2)).alias("from_s"), (part(3) * 60 + part(4)).alias("to_s"))


def format_time(seconds: Column) -> Column:
    """XmYs, or end for null."""
    whole = F.floor(seconds)
    return F.coalesce(F.concat(F.floor(whole / 60).cast("string"), F.lit("m"), (whole % 60).cast("string"), F.lit("s")), F.lit("end"))


def plain_name(name: Column) -> Column:
    """A file name without its time tag, rate tag and the suffix .wav."""
    bare = F.regexp_replace(F.regexp_replace(name, TIME_TAG, ""), r"(?i)\.wav$", "")
    return F.trim(F.regexp_replace(bare, r"[ _-]*(96kHz|44\.1kHz|44kHz)", ""))


def twins(names: DataFrame, name: str = "name") -> DataFrame:
    """high and low: each name with the high tag and its twin, by the first low tag that exists; null if none."""
    high = names.where(F.col(name).contains(HIGH_TAG)).select(F.col(name).alias("high"))
    own = names.select(F.col(name).alias("twin"))
    for i, tag in enumerate(LOW_TAGS):
        high = high.withColumn("_want", F.replace("high", F.lit(HIGH_TAG), F.lit(tag)))
        high = high.join(own.select(F.col("twin").alias("_want"), F.col("twin").alias(f"_twin{i}")), "_want", "left").drop("_want")
    return high.select("high", F.coalesce(*[F.col(f"_twin{i}") for i in range(len(LOW_TAGS))]).alias("low"))


def next_run(folders: DataFrame, name: str = "name") -> DataFrame:
    """One more than the largest n of the names [Run n]."""
    n = F.regexp_extract(name, r"\[Run (\d+)\]", 1).try_cast("int")
    return folders.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_run"))
