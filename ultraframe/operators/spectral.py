"""Short-time spectra, their inverse, and what is read off them.

One row is one frame, with its bins in an array.  The Fourier transform is
numpy's, over Arrow batches; a relational form, a join with the basis, serves
short windows and the proof of the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import power_to_db


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _frames(x: np.ndarray, n_fft: int, hop: int, pad: str) -> np.ndarray:
    if pad != "none":
        x = np.pad(x, n_fft // 2, mode="reflect" if pad == "reflect" and len(x) > n_fft // 2 else "constant")
    if len(x) < n_fft:
        return np.zeros((0, n_fft))
    return np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]


def _keys(clips: DataFrame, keep: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{c} {clips.schema[c].dataType.simpleString()}" for c in ("clip_id", "class", *keep))


def stft(clips: DataFrame, n_fft: int, hop: int, pad: str = "none", keep: tuple[str, ...] = ()) -> DataFrame:
    """clip_id, class, t, re, im and what is kept of the clip's columns: a row for each frame; pad is none, constant or reflect."""
    window = hann(n_fft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("samples")[i].values
                x = np.zeros(0) if x is None else np.asarray(x, dtype=np.float64)
                found = np.fft.rfft(_frames(x, n_fft, hop, pad) * window, axis=1)
                n, bins = found.shape
                if n:
                    edges = pa.array(np.arange(0, (n + 1) * bins, bins, dtype=np.int32))
                    parts = [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(v).ravel())) for v in (found.real, found.imag)]
                    again = pa.array(np.full(n, i))
                    yield pa.record_batch([*(batch.column(c).take(again) for c in ("clip_id", "class", *keep)), pa.array(np.arange(n, dtype=np.int32)), *parts], names=["clip_id", "class", *keep, "t", "re", "im"])

    return clips.select("clip_id", "class", *keep, "samples").mapInArrow(run, f"{_keys(clips, keep)}, t int, re array<double>, im array<double>")


def magnitude(frames: DataFrame) -> DataFrame:
    return frames.withColumn("mag", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)))


def cells(frames: DataFrame, rate: int, n_fft: int, hop: int) -> DataFrame:
    """A row for each bin of each frame, with freq and time_s."""
    out = magnitude(frames).select("clip_id", "class", "t", F.posexplode(F.arrays_zip("re", "im", "mag")).alias("k", "c"))
    return out.select("clip_id", "class", "t", "k", *_places(rate, n_fft, hop), "c.re", "c.im", "c.mag")


def _places(rate: int, n_fft: int, hop: int) -> tuple[Column, Column]:
    """freq and time_s."""
    return (F.col("k") * float(rate) / n_fft).alias("freq"), ((F.col("t") * hop + n_fft / 2) / float(rate)).alias("time_s")


def basis(spark: SparkSession, n_fft: int) -> DataFrame:
    """j, k and the windowed cosine and sine: n_fft * (n_fft / 2 + 1) rows."""
    grid = spark.range(n_fft).withColumnRenamed("id", "j").crossJoin(spark.range(n_fft // 2 + 1).withColumnRenamed("id", "k"))
    angle = 2 * F.pi() * F.col("j") * F.col("k") / n_fft
    w = 0.5 - 0.5 * F.cos(2 * F.pi() * F.col("j") / n_fft)
    return grid.select("j", "k", (w * F.cos(angle)).alias("c"), (-w * F.sin(angle)).alias("s"))


def stft_relational(clips: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """The transform as a join of samples with the basis; for short windows."""
    samples = clips.select("clip_id", "class", "samples", F.explode(F.sequence(F.lit(0), F.floor((F.size("samples") - n_fft) / hop).cast("int"))).alias("t"))
    samples = samples.select("clip_id", "class", "t", F.posexplode(F.slice("samples", F.col("t") * hop + 1, n_fft)).alias("j", "x"))
    joined = samples.join(basis(clips.sparkSession, n_fft), "j")
    return joined.groupBy("clip_id", "class", "t", F.col("k").cast("int").alias("k")).agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))


def decibels(cells: DataFrame, amin: float = 1e-5, top_db: float = 120.0) -> DataFrame:
    """cells with mag_db, relative to the loudest cell of the clip and at most top_db below it."""
    return cells.withColumn("mag_db", _relative(F.col("mag"), F.max("mag").over(Window.partitionBy("clip_id")), amin, top_db))


def _loudest(frames: DataFrame) -> DataFrame:
    """frames with an array mag and the loudest of their clip; the window orders frames, which are fewer and shorter than their cells."""
    return frames.withColumn("loudest", F.max(F.array_max("mag")).over(Window.partitionBy("clip_id")))


def frame_decibels(frames: DataFrame, amin: float = 1e-5, top_db: float = 120.0) -> DataFrame:
    """decibels of frames with an array mag: mag_db is one too."""
    return _loudest(frames).withColumn("mag_db", F.transform("mag", lambda m: _relative(m, F.col("loudest"), amin, top_db))).drop("loudest")


def decibel_cells(frames: DataFrame, rate: int, n_fft: int, hop: int, amin: float = 1e-5, top_db: float = 120.0) -> DataFrame:
    """decibels(cells(frames)), without re and im; cells are made after the window."""
    out = _loudest(magnitude(frames).select("clip_id", "class", "t", "mag")).select("clip_id", "class", "t", "loudest", F.posexplode("mag").alias("k", "mag"))
    return out.select("clip_id", "class", "t", "k", *_places(rate, n_fft, hop), "mag", _relative(F.col("mag"), F.col("loudest"), amin, top_db).alias("mag_db"))


def _relative(mag: Column, loudest: Column, amin: float, top_db: float) -> Column:
    return F.round(F.greatest(20 * F.log10(F.greatest(mag, F.lit(amin)) / F.greatest(loudest, F.lit(amin))), F.lit(-top_db)), 9)


def mel_filters(spark: SparkSession, rate: int, n_fft: int, mels: int, low: float = 0.0, high: float | None = None) -> DataFrame:
    """mel, k, weight: triangles between points that are equally far on the scale 2595 log10(1 + f / 700)."""
    high = rate / 2 if high is None else high
    to_mel = lambda f: 2595.0 * F.log10(1 + F.lit(float(f)) / 700.0)
    point = lambda i: 700.0 * (F.pow(F.lit(10.0), (to_mel(low) + (to_mel(high) - to_mel(low)) * i / (mels + 1)) / 2595.0) - 1)
    grid = spark.range(mels).withColumnRenamed("id", "mel").crossJoin(spark.range(n_fft // 2 + 1).withColumnRenamed("id", "k"))
    f, m = F.col("k") * float(rate) / n_fft, F.col("mel")
    up = (f - point(m)) / (point(m + 1) - point(m))
    down = (point(m + 2) - f) / (point(m + 2) - point(m + 1))
    return grid.select(m.cast("int").alias("mel"), F.col("k").cast("int").alias("k"), F.greatest(F.lit(0.0), F.least(up, down)).alias("weight")).where("weight > 0")


def log_mel(cells: DataFrame, rate: int, n_fft: int, mels: int) -> DataFrame:
    """clip_id, t, mel, log_mel: decibels of the mel-weighted power."""
    weighted = cells.select("clip_id", "t", "k", "mag").join(mel_filters(cells.sparkSession, rate, n_fft, mels), "k")
    total = weighted.groupBy("clip_id", "t", "mel").agg(F.sum(F.col("mag") * F.col("mag") * F.col("weight")).alias("p"))
    return total.select("clip_id", "t", "mel", power_to_db(F.col("p")).alias("log_mel"))


def mfcc(log_mels: DataFrame, mels: int, keep: int) -> DataFrame:
    """clip_id, t, c, mfcc: the orthonormal cosine transform of the log mels."""
    spark = log_mels.sparkSession
    grid = spark.range(mels).withColumnRenamed("id", "mel").crossJoin(spark.range(keep).withColumnRenamed("id", "c"))
    scale = F.when(F.col("c") == 0, F.lit(float(np.sqrt(1 / mels)))).otherwise(float(np.sqrt(2 / mels)))
    grid = grid.select(F.col("mel").cast("int").alias("mel"), F.col("c").cast("int").alias("c"), (scale * F.cos(F.pi() * F.col("c") * (2 * F.col("mel") + 1) / (2 * mels))).alias("d"))
    return log_mels.join(grid, "mel").groupBy("clip_id", "t", "c").agg(F.sum(F.col("log_mel") * F.col("d")).alias("mfcc"))


def shape(cells: DataFrame, roll: float = 0.85) -> DataFrame:
    """clip_id, centroid, rolloff and flatness of the mean spectrum of each clip."""
    mean = cells.groupBy("clip_id", "k", "freq").agg(F.avg("mag").alias("m"))
    up = Window.partitionBy("clip_id").orderBy("k")
    every = Window.partitionBy("clip_id")
    mean = mean.withColumn("cum", F.sum("m").over(up)).withColumn("total", F.sum("m").over(every))
    p = F.greatest(F.col("m") * F.col("m"), F.lit(1e-10))
    return mean.groupBy("clip_id").agg(
        (F.sum(F.col("freq") * F.col("m")) / F.nullif(F.sum("m"), F.lit(0.0))).alias("centroid"),
        F.min(F.when(F.round("cum", 9) >= F.round(roll * F.col("total"), 9), F.col("freq"))).alias("rolloff"),
        (F.exp(F.avg(F.log(p))) / F.avg(p)).alias("flatness"),
    )


def population_skew(frame: DataFrame, by: str | tuple[str, ...], value: str) -> DataFrame:
    m = F.avg(value)
    return frame.groupBy(*([by] if isinstance(by, str) else by)).agg(((F.avg(F.pow(value, F.lit(3))) - 3 * m * F.avg(F.pow(value, F.lit(2))) + 2 * F.pow(m, F.lit(3))) / F.nullif(F.pow(F.var_pop(value), F.lit(1.5)), F.lit(0.0))).alias("skew"))


def istft(frames: DataFrame, n_fft: int, hop: int, by: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """The columns of by, n, x by overlap-add, divided by the sum of squared windows; null where no window reaches.

    A frame is a row of by, t and its bins re and im.
    """
    window = hann(n_fft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            re, im = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("re", "im"))
            back = np.fft.irfft(re + 1j * im, n=n_fft, axis=1) * window
            at = np.asarray(batch.column("t"))[:, None] * hop + np.arange(n_fft)
            again = pa.array(np.repeat(np.arange(batch.num_rows), n_fft))
            keys = [batch.column(c).take(again) for c in by]
            yield pa.record_batch([*keys, pa.array(at.ravel().astype(np.int32)), pa.array(back.ravel()), pa.array(np.tile(window * window, batch.num_rows))], names=[*by, "n", "y", "w"])

    shape = "".join(f"{c} {frames.schema[c].dataType.simpleString()}, " for c in by)
    parts = frames.select(*by, "t", "re", "im").mapInArrow(run, f"{shape}n int, y double, w double")
    return parts.groupBy(*by, "n").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).select(*by, "n", F.when(F.col("w") > 1e-10, F.col("y") / F.col("w")).alias("x"))


def framed(cells: DataFrame, by: tuple[str, ...] = ("clip_id",), bin: str = "f") -> DataFrame:
    """Cells with re and im, one row a bin, as frames: by, t and the bins in order."""
    rows = cells.groupBy(*by, "t").agg(F.array_sort(F.collect_list(F.struct(F.col(bin).alias("f"), "re", "im"))).alias("c"))
    return rows.select(*by, "t", F.transform("c", lambda x: x["re"]).alias("re"), F.transform("c", lambda x: x["im"]).alias("im"))


def window_of(rate: Column, milliseconds: float) -> tuple[Column, Column]:
    """Samples of a window of so many milliseconds, and its hop of a quarter."""
    n = (rate * milliseconds / 1000).cast("bigint")
    return n, F.floor(n / 4).cast("bigint")


def check_config(rate: int, n_fft: int, hop: int, low: float = 0.0, high: float | None = None) -> None:
    """Raises ValueError where frames or mel filters could not be built."""
    if rate <= 0 or n_fft <= 0 or n_fft % 2 or not 0 < hop <= n_fft:
        raise ValueError(f"rate {rate}, n_fft {n_fft}, hop {hop}: rate and n_fft must be positive, n_fft even, and hop from 1 to n_fft")
    if not 0 <= low < (rate / 2 if high is None else high) <= rate / 2:
        raise ValueError(f"mel filters from {low} to {high} Hz don't fit below {rate / 2} Hz")


def unit_phase(re: Column, im: Column) -> tuple[Column, Column]:
    mag = F.sqrt(re * re + im * im)
    return F.when(mag > 0, re / mag).otherwise(1.0), F.when(mag > 0, im / mag).otherwise(0.0)


def resample(clips: DataFrame, rate: int, to: int) -> DataFrame:
    """clips with samples at another rate, through the spectrum of each whole clip; long.resample filters clips of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("samples").to_pylist():
                x = np.asarray(x or [], dtype=np.float64)
                n = int(len(x) / rate * to)
                found = np.fft.rfft(x) if len(x) else np.zeros(0)
                out.append((np.fft.irfft(found[: n // 2 + 1], n) * (n / len(x))).tolist() if n else [])
            yield pa.record_batch([batch.column("clip_id"), batch.column("class"), pa.array(out, pa.list_(pa.float64()))], names=["clip_id", "class", "samples"])

    return clips.select("clip_id", "class", "samples").mapInArrow(run, f"{_keys(clips)}, samples array<double>")
