"""Clips taken apart into sources, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, factors, separation, spectral
from ..sources.storage import write


def source_factors(w: DataFrame, h: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Factors (clip_id, f, k, w) and (clip_id, k, t, h) with the components of a cluster (clip_id, k, cluster) added up to one source."""
    add = lambda x, key, value: x.join(labels, ["clip_id", "k"]).groupBy("clip_id", F.col("cluster").alias("k"), key).agg(F.sum(value).alias(value))
    return add(w, "f", "w"), add(h, "t", "h")


def separate(clips: DataFrame, rate: int, n_fft: int, hop: int, k: int, sources: int, spectra: factors.Factor, gains: factors.Factor, rule: factors.Rule | None = None, steps: int = 50, tolerance: float = 1e-4, method: str = "spectral", temporal_weight: float = 0.6, mels: int = 128, keep: int = 13, mask: str = "soft", power: float = 2.0, kernel: int = 5, floor: float = 0.1, width: float = 0.05, length: int = factors.CHUNK) -> DataFrame:
    """clip_id, k, n, x: a signal for each source of each clip (clip_id, class, samples).

    Frames are transformed and written once; k components are fitted, clustered
    into sources, and the sources' masks are laid over the frames.
    """
    spectral.check_config(rate, n_fft, hop)
    frames = write(spectral.stft(clips, n_fft, hop)).frame
    w, h, _ = factors.factorize(spectral.magnitude(frames).select("clip_id", "t", "mag"), k, spectra, gains, rule, steps, tolerance, length=length)
    by_bin = w.select("clip_id", "k", F.col("f").alias("i"), F.col("w").alias("x"))
    by_frame = h.select("clip_id", "k", F.col("t").alias("i"), F.col("h").alias("x"))
    labels = cluster.labelled(by_bin, by_frame, sources, method, rate, n_fft, mels, keep, temporal_weight)
    parts = separation.masked_frames(frames, *source_factors(w, h, labels), mask, power, kernel, floor, width, length)
    return spectral.istft(parts, n_fft, hop, ("clip_id", "k"))
