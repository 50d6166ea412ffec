"""Queries of recordings that no row holds, with their SQL: the clips cut into blocks shorter than a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, long
from ..operators.spectral import frame_decibels, magnitude, stft
from ..sources import tables as T
from . import oracles as O
from .queries import AUDIBLE, LEAST, SNR, r

#: Samples of a block, and the rate that clips of 64 Hz are brought to.
BLOCK, TO = 10, 48


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return long.blocks(T.clips(spark, sf), BLOCK)


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return magnitude(long.stft(_blocks(spark, sf), BLOCK, T.N_FFT, T.HOP))


def _cells(frames: DataFrame, value: str) -> DataFrame:
    return frames.select("clip_id", F.col("t").cast("int").alias("t"), F.posexplode(value).alias("k", value))


def long_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_frames(spark, sf), "mag").select("clip_id", "t", "k", r("mag"))


def long_decibels(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(long.decibels(_frames(spark, sf)), "mag_db").select("clip_id", "t", "k", (F.col("mag_db") + 0.0).alias("mag_db"))


def resampled(spark: SparkSession, sf: str) -> DataFrame:
    found = long.resample(_blocks(spark, sf), BLOCK, T.RATE, TO).select("clip_id", "first", F.posexplode("samples").alias("i", "x"))
    return found.select("clip_id", (F.col("first") + F.col("i")).cast("int").alias("n"), r("x"))


def counted_floors(spark: SparkSession, sf: str) -> DataFrame:
    frames = frame_decibels(magnitude(stft(T.clips(spark, sf), T.N_FFT, T.HOP)).select("clip_id", "mag"))
    found = activity.counted_floors(frames.select("clip_id", "mag_db"), T.RATE, T.N_FFT, AUDIBLE, snr_db=SNR, least_db=LEAST)
    return found.select("clip_id", *[r(c, 4) for c in ("noise_global_db", "noise_audible_db", "noise_ultra_db", "global_threshold_db", "ultra_threshold_db")])


QUERIES = {f.__name__: f for f in (long_spectrum, long_decibels, resampled, counted_floors)}

# A sinc of 24 zero crossings a side under a Hann window: cut off at 0.95 of the lower Nyquist frequency, so 34 samples a side.
FILTER = "0.7125 * (case when d = 0 then 1 else sin(pi() * 0.7125 * d) / (pi() * 0.7125 * d) end) * (0.5 + 0.5 * cos(pi() * d / 34))"
SQL = {
    "long_spectrum": f"with {O.CELLS} select clip_id, t, k, round(mag, 6) + 0.0 as mag from cells",
    "long_decibels": O.SQL["spectrogram_db"],
    "resampled": f"with {O.CLIPS}, p as (select clip_id, m, x, m * 4 / 3.0::double - n as d from s, range({TO}) as q(m)) select clip_id, m::int as n, round(sum(x * {FILTER}), 6) + 0.0 as x from p where abs(d) < 34 group by all",
    "counted_floors": O.SQL["noise_floors"],
}
