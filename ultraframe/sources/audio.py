"""Recordings as files: scans, headers, decoding and writing of PCM WAV.

Compressed formats are listed by the scan, but only PCM WAV can be decoded
here; what can't be read has a null header and is left out by `readable`.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import class_report, confusion, macro_scores
from ..operators.evaluate import accuracy as share_right
from ..operators.spectral import magnitude, resample, stft, unit_phase
from . import recordings as R

# File name endings of recordings.
ENDINGS = (".wav", ".mp3", ".flac", ".ogg", ".aiff", ".aif")
MORE_ENDINGS = (*ENDINGS, ".m4a", ".aac")


def scan(spark: SparkSession, root: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """path, class (the folder right below root), content; the content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ending = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    below = F.regexp_extract("path", f"{root.rstrip('/')}/([^/]+)/", 1)
    return files.where(ending.isin(*endings)).select("path", F.nullif(below, F.lit("")).alias("class"), "content")


def recordings(spark: SparkSession, path: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """scan of a folder, or of the folder of one file with that file alone; no rows if the path is missing or of another kind."""
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = java.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(java):
        return spark.createDataFrame([], "path string, class string, content binary")
    return scan(spark, path, endings)


def listed(spark: SparkSession, folders: list[str], endings: tuple[str, ...] = (".wav", ".flac")) -> DataFrame:
    """Recordings of several folders, each file once though folders overlap."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
    ending = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.where(ending.isin(*endings)).select("path", F.lit(None).cast("string").alias("class"), "content").dropDuplicates(["path"])


def evaluated(spark: SparkSession, root: str) -> DataFrame:
    """scan for evaluation, which takes more endings."""
    return scan(spark, root, MORE_ENDINGS)


def _raw(data: bytes) -> tuple[int, int, np.ndarray]:
    """Bytes of an unreadable header as 16-bit samples after it: rate unknown, so 0."""
    if data[:4] != b"RIFF" or (at := data.find(b"data")) < 0:
        raise EOFError("no samples")
    body = data[at + 8 :]
    x = np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float64) / 2**15
    return 0, len(x), x


def _decode(raw: bytes, start: int = 0, stop: int | None = None) -> tuple[int, int, np.ndarray]:
    with wave.open(io.BytesIO(raw)) as f:
        rate, n, width, channels = f.getframerate(), f.getnframes(), f.getsampwidth(), f.getnchannels()
        start = min(start, n)
        f.setpos(start)
        data = f.readframes(max(0, (n if stop is None else min(stop, n)) - start))
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float64) / 2**23
    else:
        x = np.frombuffer(data, np.dtype(f"<i{width}")).astype(np.float64) / 2 ** (8 * width - 1)
    return rate, n, x.reshape(-1, channels).mean(axis=1)


def headers(files: DataFrame) -> DataFrame:
    """path, class, sample_rate, n_frames; nulls where the header can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch["content"]:
                try:
                    with wave.open(io.BytesIO(raw)) as f:
                        rows.append((f.getframerate(), f.getnframes()))
                except (wave.Error, EOFError):
                    rows.append((None, None))
            yield pd.DataFrame({"path": batch["path"], "class": batch["class"], "sample_rate": pd.array([r for r, _ in rows], "Int32"), "n_frames": pd.array([n for _, n in rows], "Int64")})

    return files.mapInPandas(run, "path string, class string, sample_rate int, n_frames bigint")


def readable(found: DataFrame) -> DataFrame:
    return found.where("n_frames is not null")


def decode(files: DataFrame, start_s: float | None = None, end_s: float | None = None, samples: tuple[int, int] | None = None, fallback: bool = False) -> DataFrame:
    """path, class, sample_rate, samples: mono, from -1 to 1, of a stretch of time, of samples from and up to, or the whole.

    An end without a start is not heeded.  What can't be read is left out, or with
    fallback read as plain 16-bit samples behind a damaged header, at rate 0.
    """

    def one(raw: bytes) -> tuple[int, np.ndarray]:
        try:
            with wave.open(io.BytesIO(raw)) as f:
                rate = f.getframerate()
            low, high = samples or (int((start_s or 0) * rate), None if end_s is None or start_s is None else int(end_s * rate))
            return rate, _decode(raw, low, high)[2]
        except (wave.Error, EOFError):
            if not fallback:
                raise
            rate, _, x = _raw(raw)
            return rate, x[slice(*(samples or (0, None)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, label, raw in zip(batch["path"], batch["class"], batch["content"]):
                try:
                    rate, x = one(raw)
                except (wave.Error, EOFError):
                    continue
                rows.append((path, label, rate, x.tolist()))
            yield pd.DataFrame(rows, columns=["path", "class", "sample_rate", "samples"])

    return files.mapInPandas(run, "path string, class string, sample_rate int, samples array<double>")


def spectrum_of(files: DataFrame, rate: int, n_fft: int, hop: int) -> DataFrame:
    """Files decoded, brought to one rate and transformed: clip_id (the path), class, sample_rate, n_samples, t, re, im, mag and the unit phase (cos, sin)."""
    clips = decode(files).select(F.col("path").alias("clip_id"), F.col("class"), "sample_rate", "samples")
    rates = [x.sample_rate for x in clips.select("sample_rate").distinct().collect()]  # a handful of rates
    same = [resample(clips.where(F.col("sample_rate") == x), x, rate) for x in rates]
    whole = reduce(DataFrame.union, same) if same else clips.drop("sample_rate")
    sized = whole.withColumns({"sample_rate": F.lit(rate), "n_samples": F.size("samples")})
    frames = magnitude(stft(sized, n_fft, hop, "reflect", ("sample_rate", "n_samples")))
    phase = lambda part: F.transform(F.arrays_zip("re", "im"), lambda c: unit_phase(c["re"], c["im"])[part])
    return frames.withColumns({"cos": phase(0), "sin": phase(1)})


def encode(clips: DataFrame, rate: int) -> DataFrame:
    """clips with content: their samples as 16-bit WAV."""

    @F.pandas_udf("binary")
    def pack(samples: pd.Series) -> pd.Series:
        out = []
        for x in samples:
            to = io.BytesIO()
            with wave.open(to, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(rate)
                f.writeframes((np.clip(np.asarray(x, dtype=np.float64), -1, 1 - 2**-15) * 2**15).round().astype("<i2").tobytes())
            out.append(to.getvalue())
        return pd.Series(out)

    return clips.withColumn("content", pack("samples"))


def write(encoded: DataFrame, folder: str, name: str = "name") -> None:
    """Writes content as folder/name, all files or none: tasks stage them, and a commit moves them into place."""
    R.write(encoded.select(F.col(name).cast("string").alias("name"), "content"), folder)


def write_report(frame: DataFrame, path: str, kind: str = "csv", other: str | None = None) -> str:
    """A small table as one CSV file with a header, as JSON lines, or as text in columns of 20; returns where it went.

    CSV begins with a byte order mark.  If path can't be written, other is taken.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if kind == "json":
        lines = frame.select(F.to_json(F.struct("*")).alias("value"))
    elif kind == "csv":
        names = [F.lit("\ufeff" * (i == 0) + c).alias(f"c{i}") for i, c in enumerate(frame.columns)]
        head = frame.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("_place"), F.to_csv(F.struct(*names)).alias("value"))
        # One small file: the header first, then the rows in their order.
        rows = frame.select(F.monotonically_increasing_id().alias("_place"), F.to_csv(F.struct("*")).alias("value"))
        lines = head.union(rows).repartition(1).sortWithinPartitions("_place").select("value")
    else:
        lines = frame.select(F.format_string("".join("%-20s" for _ in frame.columns), *map(text, frame.columns)).alias("value"))
    for place in (path, other):
        try:
            lines.coalesce(1).write.mode("overwrite").text(place)
            return place
        except Exception:
            if other is None or place == other:
                raise
    raise AssertionError


def write_metrics(preds: DataFrame, labels: DataFrame, folder: str, prefix: str) -> list[str]:
    """Files of an evaluation of preds (label, pred) over the known classes (column class); returns where they went.

    The confusion matrix, and its rows as shares, as CSV with a row for each
    label and a column for each prediction; the report by class as CSV and as
    text; accuracy and macro means as JSON.
    """
    cells = confusion(preds, labels)
    order = [r[0] for r in labels.select("class").distinct().orderBy("class").collect()]  # the classes
    wide = lambda value: cells.groupBy("label").pivot("pred", order).agg(F.first(value)).orderBy("label")
    rows = class_report(preds, labels)
    whole = share_right(preds).crossJoin(macro_scores(preds))  # one row each
    files = [(wide("n"), "confusion_matrix.csv", "csv"), (wide("share"), "confusion_matrix_normalized.csv", "csv"), (rows, "report.csv", "csv"), (rows, "report.txt", "text"), (whole, "metrics.json", "json")]
    return [write_report(frame, f"{folder.rstrip('/')}/{prefix}_{name}", kind) for frame, name, kind in files]
