"""Spectra and resampling of recordings of any length.

A recording is rows of blocks (clip_id, first, samples): first is the place of
the first sample, and all blocks of a recording but its last have the same
length.  Work on a block needs some samples of its neighbours; `overlapped`
sends just those, so no task ever holds a recording.  Frames are numbered over
the whole recording, and each belongs to the block it begins in.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factors import rows_of
from .spectral import hann

#: Zero crossings of the resampling filter on each side, and the share of the band that passes.
ZEROS, PASS = 24, 0.95


def blocks(clips: DataFrame, length: int) -> DataFrame:
    """clip_id, first, samples: clips (clip_id, samples) cut into blocks; empty and null ones have none."""
    cut = clips.where(F.size("samples") > 0).select("clip_id", "samples", F.explode(F.sequence(F.lit(0), F.size("samples") - 1, F.lit(length))).alias("at"))
    return cut.select("clip_id", F.col("at").cast("bigint").alias("first"), F.slice("samples", F.col("at") + 1, length).alias("samples"))


def overlapped(blocks: DataFrame, length: int, left: int, right: int) -> DataFrame:
    """clip_id, first, n, start, samples: each block with up to left samples before it and right after it; start is the place of the first of samples, n the block's own length.

    A block sends each neighbour in reach what that lacks, and itself all it has.
    """
    own, size = F.col("first"), F.size("samples")
    reach = blocks.withColumn("to", F.explode(F.sequence(F.greatest(own - ceil(right / length) * length, F.lit(0)), own + ceil(left / length) * length, F.lit(length).cast("bigint"))))
    low, high = F.greatest(own, F.col("to") - left), F.least(own + size, F.col("to") + length + right)
    parts = reach.select("clip_id", "to", low.alias("start"), F.when(high > low, F.slice("samples", (low - own + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))).alias("x"), F.when(F.col("to") == own, size).alias("n"))
    whole = parts.where("x is not null").groupBy("clip_id", "to").agg(F.array_sort(F.collect_list(F.struct("start", "x"))).alias("c"), F.max("n").alias("n"))
    return whole.where("n is not null").select("clip_id", F.col("to").alias("first"), "n", F.col("c")[0]["start"].alias("start"), F.flatten(F.transform("c", lambda p: p["x"])).alias("samples"))


def stft(blocks: DataFrame, length: int, n_fft: int, hop: int, pad: str = "none") -> DataFrame:
    """clip_id, t, re, im: the frames of recordings given as blocks, as of one array; pad is none or constant (half a window of zeros at both ends)."""
    if pad not in ("none", "constant"):
        raise ValueError("pad is none or constant")
    window, half = hann(n_fft), n_fft // 2 if pad == "constant" else 0
    key = blocks.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, (x,) in rows_of(batches, "samples"):
            first, n = batch.column("first")[i].as_py(), batch.column("n")[i].as_py()
            # A frame begins half a window before its place; the first block has those that begin before it as well.
            low = 0 if first == 0 else -(-(first + half) // hop)
            high = -(-(first + n + half) // hop)
            begin = np.arange(low, high) * hop - half - first
            begin = begin[begin + n_fft <= len(x) + half]
            if not len(begin):
                continue
            padded = np.concatenate([np.zeros(half if first == 0 else 0), x, np.zeros(half)])
            view = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[begin + (half if first == 0 else 0)]
            found = np.fft.rfft(view * window, axis=1)
            count, bins = found.shape
            edges = pa.array(np.arange(0, (count + 1) * bins, bins, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(v).ravel())) for v in (found.real, found.imag)]
            yield pa.record_batch([batch.column("clip_id").take(pa.array(np.full(count, i))), pa.array(np.arange(low, low + count, dtype=np.int64)), *lists], names=["clip_id", "t", "re", "im"])

    return overlapped(blocks, length, 0, n_fft - 1).mapInArrow(run, f"clip_id {key}, t bigint, re array<double>, im array<double>")


def decibels(frames: DataFrame, amin: float = 1e-5, top_db: float = 120.0) -> DataFrame:
    """frames (clip_id, t, mag array) with mag_db, an array, relative to the loudest cell of the recording; that is aggregated, not looked up in a window that would hold it."""
    loudest = frames.groupBy("clip_id").agg(F.max(F.array_max("mag")).alias("loudest"))
    db = lambda m: F.round(F.greatest(20 * F.log10(F.greatest(m, F.lit(amin)) / F.greatest(F.col("loudest"), F.lit(amin))), F.lit(-top_db)), 9)
    return frames.join(loudest, "clip_id").withColumn("mag_db", F.transform("mag", db)).drop("loudest")


def bank(up: int, down: int, zeros: int = ZEROS) -> tuple[np.ndarray, int]:
    """A row of taps for each of the up phases, and how many taps lie before an output's place: a sinc under a Hann window, cut off below both Nyquist frequencies."""
    cutoff = PASS * min(1.0, up / down)
    half = ceil(zeros / cutoff)
    at = np.arange(up)[:, None] / up - np.arange(-half, half + 1)[None, :]
    taps = cutoff * np.sinc(cutoff * at) * np.where(np.abs(at) < half, 0.5 + 0.5 * np.cos(np.pi * at / half), 0.0)
    return taps, half


def resample(blocks: DataFrame, length: int, rate: int, to: int, zeros: int = ZEROS) -> DataFrame:
    """clip_id, first, samples: blocks at another rate by a polyphase filter; a recording of n samples has floor(n * to / rate).

    Output m lies at m * rate / to and belongs to the block it lies in.
    Beyond the ends are zeros.
    """
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    taps, half = bank(up, down, zeros)
    key = blocks.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, (x,) in rows_of(batches, "samples"):
            first, n, start = (batch.column(c)[i].as_py() for c in ("first", "n", "start"))
            low, high = -(-first * up // down), -(-(first + n) * up // down)
            if start + len(x) == first + n:  # the last block: as many as the length gives
                high = min(high, (first + n) * up // down)
            m = np.arange(low, high)
            padded = np.concatenate([np.zeros(half - (first - start)), x, np.zeros(half + 1)])
            at = m * down // up - first
            view = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)[at]
            y = np.einsum("ij,ij->i", view, taps[m * down % up])
            yield pa.record_batch([batch.column("clip_id").slice(i, 1), pa.array([low], pa.int64()), pa.array([y], pa.list_(pa.float64()))], names=["clip_id", "first", "samples"])

    return overlapped(blocks, length, half, half).mapInArrow(run, f"clip_id {key}, first bigint, samples array<double>").where(F.size("samples") > 0)


def whole(blocks: DataFrame) -> DataFrame:
    """clip_id, samples: blocks put together again, for recordings that a row can hold."""
    return blocks.groupBy("clip_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "samples"))), lambda b: b["samples"])).alias("samples"))
