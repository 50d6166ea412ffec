"""Activity above the audible band: thresholds, frames, windows and frequencies.

Input is the cells of a spectrogram in decibels: clip_id, t, k, freq, time_s,
mag_db.  A clip without bins above the audible limit gets the status no_band
and nulls; a clip without playing frames has null ratios.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import half_even, ratio, whole
from .counted import percentiles

# The defaults of the analysis.
AUDIBLE_HZ, SNR_DB, MIN_LEVEL_DB, PLAYING_DB, FLOOR_SHARE, WINDOW_S = 20_000.0, 10.0, -70.0, -15.0, 0.1, 1.0


def noise_floors(cells: DataFrame, audible: float = AUDIBLE_HZ, share: float = FLOOR_SHARE, snr_db: float = SNR_DB, least_db: float = MIN_LEVEL_DB, approximate: bool = False) -> DataFrame:
    """clip_id, the floors of all, audible and ultrasonic cells, and the thresholds over them.

    Exact percentiles keep the values of a clip in one aggregation buffer; for
    very long clips counted_floors gives the same without one, and
    approximate=True percentile_approx.
    """
    low = F.col("freq") <= audible
    at = (lambda c: F.percentile_approx(c, share)) if approximate else (lambda c: F.percentile(c, F.lit(share)))
    out = cells.groupBy("clip_id").agg(
        at(F.col("mag_db")).alias("noise_global_db"),
        at(F.when(low, F.col("mag_db"))).alias("noise_audible_db"),
        at(F.when(~low, F.col("mag_db"))).alias("noise_ultra_db"),
    )
    return _thresholds(out, snr_db, least_db)


def counted_floors(frames: DataFrame, rate: int, n_fft: int, audible: float = AUDIBLE_HZ, share: float = FLOOR_SHARE, snr_db: float = SNR_DB, least_db: float = MIN_LEVEL_DB) -> DataFrame:
    """noise_floors by counting, of frames (clip_id, mag_db array) of clips of any length: no buffer holds the values of a clip, and no cell is a row before it is counted."""
    low = lambda k: k * float(rate) / n_fft <= audible
    parts = {"global": F.col("mag_db"), "audible": F.filter("mag_db", lambda _, k: low(k)), "ultra": F.filter("mag_db", lambda _, k: ~low(k))}
    values = frames.select("clip_id", F.inline(F.array(*[F.struct(F.lit(name).alias("band"), x.alias("x")) for name, x in parts.items()])))
    found = percentiles(values, ["clip_id", "band"], share)
    of = lambda name: F.max(F.when(F.col("band") == name, F.col("value"))).alias(f"noise_{name}_db")
    return _thresholds(found.groupBy("clip_id").agg(*map(of, ("global", "audible", "ultra"))), snr_db, least_db)


def _thresholds(floors: DataFrame, snr_db: float, least_db: float) -> DataFrame:
    for name in ("global", "ultra"):
        floors = floors.withColumn(f"{name}_threshold_db", F.greatest(F.col(f"noise_{name}_db") + snr_db, F.lit(float(least_db))))
    return floors.withColumn("status", F.when(F.col("noise_ultra_db").isNull(), "no_band").otherwise("ok"))


def frames(cells: DataFrame, floors: DataFrame, audible: float = AUDIBLE_HZ, playing_db: float = PLAYING_DB) -> DataFrame:
    """clip_id, t, time_s, playing, ultra, and the highest frequency over the global threshold."""
    low = F.col("freq") <= audible
    # One row a clip is held; cells pass by unsorted.
    joined = cells.join(floors.select("clip_id", "global_threshold_db", "ultra_threshold_db").hint("shuffle_hash"), "clip_id")
    return joined.groupBy("clip_id", "t", "time_s").agg(
        (F.coalesce(F.max(F.when(low, F.col("mag_db"))), F.lit(float("-inf"))) > playing_db).alias("playing"),
        F.coalesce(F.bool_or(F.when(~low, F.col("mag_db") > F.col("ultra_threshold_db"))), F.lit(False)).alias("ultra"),
        F.max(F.when(F.col("mag_db") > F.col("global_threshold_db"), F.col("freq"))).alias("top_freq"),
    )


def share_of_frames(frames: DataFrame) -> DataFrame:
    """clip_id, n_play_frames, n_ultra_frames, pua_frame: the playing frames, and how many have ultrasound."""
    n, both = F.count_if("playing"), F.count_if(F.col("playing") & F.col("ultra"))
    return frames.groupBy("clip_id").agg(n.alias("n_play_frames"), both.alias("n_ultra_frames"), ratio(both, n).alias("pua_frame"))


def share_of_windows(frames: DataFrame, seconds: float = WINDOW_S) -> DataFrame:
    """clip_id, n_windows, pua_sec: the mean over the windows with playing frames.

    Windows are half open; a last frame exactly on the end of a whole number
    of windows is in none of them.
    """
    last = frames.groupBy("clip_id").agg(F.max("time_s").alias("end"))
    placed = frames.join(last, "clip_id").withColumn("window", F.floor(F.col("time_s") / seconds)).where(F.col("window") < F.ceil(F.col("end") / seconds))
    per = placed.groupBy("clip_id", "window").agg(ratio(F.count_if(F.col("playing") & F.col("ultra")), F.count_if("playing")).alias("share"))
    return per.groupBy("clip_id").agg(F.count("share").alias("n_windows"), F.avg("share").alias("pua_sec"))


def frequency_counts(cells: DataFrame, floors: DataFrame, frames: DataFrame) -> DataFrame:
    """clip_id, k, freq, n: in how many playing frames each bin exceeds the global threshold; 0 stays."""
    joined = cells.join(floors.select("clip_id", "global_threshold_db"), "clip_id").join(frames.select("clip_id", "t", "playing"), ["clip_id", "t"])
    return joined.groupBy("clip_id", "k", "freq").agg(F.count_if(F.col("playing") & (F.col("mag_db") > F.col("global_threshold_db"))).alias("n"))


def top_frequency(frames: DataFrame) -> DataFrame:
    """clip_id, t, time_s, top_freq of the playing frames."""
    return frames.where("playing").select("clip_id", "t", "time_s", "top_freq")


def histogram(frame: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """bin and n over equal widths between the least and largest finite value, which is in the last bin."""
    finite = frame.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))).select(F.col(value).alias("v"))
    ends = finite.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    place = F.coalesce(F.least(F.floor((F.col("v") - F.col("low")) / width * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    # ends is one row.
    return finite.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def floored(cells: DataFrame, audible: float = AUDIBLE_HZ, share: float = FLOOR_SHARE, snr_db: float = SNR_DB, least_db: float = MIN_LEVEL_DB) -> DataFrame:
    """cells with the floors and thresholds of noise_floors, by a window over each clip: no join, and cells are read once."""
    clip, low = Window.partitionBy("clip_id"), F.col("freq") <= audible
    value = {"global": F.col("mag_db"), "audible": F.when(low, F.col("mag_db")), "ultra": F.when(~low, F.col("mag_db"))}
    out = cells.withColumns({f"noise_{n}_db": F.percentile(v, F.lit(share)).over(clip) for n, v in value.items()})
    return out.withColumns({f"{n}_threshold_db": F.greatest(F.col(f"noise_{n}_db") + snr_db, F.lit(float(least_db))) for n in ("global", "ultra")})


def summary(cells: DataFrame, audible: float = AUDIBLE_HZ, snr_db: float = SNR_DB, least_db: float = MIN_LEVEL_DB, playing_db: float = PLAYING_DB, seconds: float = WINDOW_S) -> DataFrame:
    """One row for each clip: shares, counts, highest frequencies and floors, rounded for a report.

    Cells are grouped to frames, frames to windows and windows to clips, all
    under one partitioning by clip.
    """
    noise = [f"noise_{n}_db" for n in ("global", "audible", "ultra")]
    kept = [F.first(c).alias(c) for c in noise]
    low = F.col("freq") <= audible
    frames = floored(cells, audible, snr_db=snr_db, least_db=least_db).groupBy("clip_id", "t", "time_s").agg(
        (F.coalesce(F.max(F.when(low, F.col("mag_db"))), F.lit(float("-inf"))) > playing_db).alias("playing"),
        F.coalesce(F.bool_or(F.when(~low, F.col("mag_db") > F.col("ultra_threshold_db"))), F.lit(False)).alias("ultra"),
        F.max(F.when(F.col("mag_db") > F.col("global_threshold_db"), F.col("freq"))).alias("top"),
        *kept,
    )
    top = F.when(F.col("playing"), F.col("top"))
    windows = frames.groupBy("clip_id", F.floor(F.col("time_s") / seconds).alias("window")).agg(
        F.count_if("playing").alias("n"),
        F.count_if(F.col("playing") & F.col("ultra")).alias("both"),
        F.max("time_s").alias("last"),
        F.max(top).alias("max_freq"),
        F.max(F.when(top > audible, top)).alias("max_ultra"),
        *kept,
    )
    # A last frame exactly on the end of a whole number of windows is in none of them.
    inside = F.col("window") < F.ceil(F.max("last").over(Window.partitionBy("clip_id")) / seconds)
    windows = windows.withColumn("share", F.when(inside, ratio(F.col("both"), F.col("n"))))
    out = windows.groupBy("clip_id").agg(F.sum("n").alias("n"), F.sum("both").alias("both"), F.avg("share").alias("pua_sec"), F.max("max_freq").alias("max_freq"), F.max("max_ultra").alias("max_ultra"), *kept)
    return out.select(
        "clip_id",
        half_even(ratio(F.col("both"), F.col("n"))).alias("pua_frame"),
        half_even(F.col("pua_sec")).alias("pua_sec"),
        F.col("n").alias("n_play_frames"),
        F.col("both").alias("n_ultra_frames"),
        whole(F.col("max_freq")).alias("max_freq_overall_hz"),
        whole(F.col("max_ultra")).alias("max_ultrasonic_freq_hz"),
        *noise,
        F.when(F.col("noise_ultra_db").isNull(), "no_band").otherwise("ok").alias("status"),
    )


def overlay(cells: DataFrame, floors: DataFrame, frames: DataFrame, audible: float = AUDIBLE_HZ) -> DataFrame:
    """clip_id, t, k, mag_db, mask: ultrasonic cells over their threshold in playing frames, as a plot shows them."""
    joined = cells.join(floors.select("clip_id", "ultra_threshold_db"), "clip_id").join(frames.select("clip_id", "t", "playing"), ["clip_id", "t"])
    mask = F.col("playing") & (F.col("freq") > audible) & (F.col("mag_db") > F.col("ultra_threshold_db"))
    return joined.select("clip_id", "t", "k", "mag_db", F.coalesce(mask, F.lit(False)).alias("mask"))
