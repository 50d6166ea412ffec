"""Non-negative factors, masks and separation measures.

Factors are long tables w (clip_id, f, k, w) and h (clip_id, k, t, h); v is
(clip_id, f, t, v).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clip, decibel_ratio, dot, sigmoid
from .factors import CHUNK, EPS, CoordinateDescent, Multiplicative, Rule, as_lists, local, packed, rows_of, stacked, stacks
from .spectral import framed, istft, unit_phase


def measures(triples: DataFrame, rate: int) -> DataFrame:
    """clip_id, sdr, si_sdr, sir, duration_s of ref, est and other, all cut to the shortest."""
    n = F.least(F.size("ref"), F.size("est"), F.size("other"))
    t = triples.select("clip_id", *[F.slice(c, 1, n).alias(c) for c in ("ref", "est", "other")])
    noise = F.zip_with("ref", "est", lambda a, b: a - b)
    sdr = decibel_ratio(dot("ref", "ref"), dot(noise, noise))
    # Sums of centred products need only sums: sum((a - ma)(b - mb)) = sum(ab) - n ma mb.
    size, total = F.size("ref"), lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    t = t.select("clip_id", sdr.alias("sdr"), size.alias("size"), *[(dot(a, b) - total(F.col(a)) * total(F.col(b)) / size).alias(f"{a}_{b}") for a, b in (("ref", "ref"), ("est", "est"), ("ref", "est"), ("other", "other"), ("other", "est"))])
    scale = F.col("ref_est") / (F.col("ref_ref") + 1e-12)
    target = scale * scale * F.col("ref_ref")
    rest = F.greatest(F.col("est_est") - 2 * scale * F.col("ref_est") + target, F.lit(0.0))
    across = F.col("other_est") / (F.col("other_other") + 1e-12)
    return t.select("clip_id", "sdr", decibel_ratio(target, rest).alias("si_sdr"), decibel_ratio(target, across * across * F.col("other_other")).alias("sir"), (F.col("size") / float(rate)).alias("duration_s"))


def product(w: DataFrame, h: DataFrame) -> DataFrame:
    """clip_id, f, t, vhat: the factors multiplied."""
    return w.join(h, ["clip_id", "k"]).groupBy("clip_id", "f", "t").agg(F.sum(F.col("w") * F.col("h")).alias("vhat"))


def kl_step(v: DataFrame, w: DataFrame, h: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One update for the Kullback-Leibler loss on long tables: h, then w with the new h, then columns of w with norm 1 and h scaled to match.

    factors.Normalized is the same step on chunks of frames.
    """

    def quotient(w: DataFrame, h: DataFrame) -> DataFrame:
        return v.join(product(w, h), ["clip_id", "f", "t"]).select("clip_id", "f", "t", (F.col("v") / F.greatest("vhat", F.lit(EPS))).alias("q"))

    def renewed(old: str) -> Column:
        return F.greatest(F.col(old) * F.col("up") / (F.col("down") + EPS), F.lit(EPS)).alias(old)

    up = quotient(w, h).join(w, ["clip_id", "f"]).groupBy("clip_id", "k", "t").agg(F.sum(F.col("q") * F.col("w")).alias("up"))
    down = w.groupBy("clip_id", "k").agg(F.sum("w").alias("down"))
    h1 = h.join(up, ["clip_id", "k", "t"]).join(down, ["clip_id", "k"]).select("clip_id", "k", "t", renewed("h"))
    up = quotient(w, h1).join(h1, ["clip_id", "t"]).groupBy("clip_id", "f", "k").agg(F.sum(F.col("q") * F.col("h")).alias("up"))
    down = h1.groupBy("clip_id", "k").agg(F.sum("h").alias("down"))
    w1 = w.join(up, ["clip_id", "f", "k"]).join(down, ["clip_id", "k"]).select("clip_id", "f", "k", renewed("w"))
    norm = w1.groupBy("clip_id", "k").agg((F.sqrt(F.sum(F.col("w") * F.col("w"))) + EPS).alias("norm"))
    h1 = h1.join(norm, ["clip_id", "k"]).select("clip_id", "k", "t", (F.col("h") * F.col("norm")).alias("h"))
    return w1.join(norm, ["clip_id", "k"]).select("clip_id", "f", "k", (F.col("w") / F.col("norm")).alias("w")), h1


def start_factors(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative double singular vectors of a spectrum, or of each of a stack; zeros become its mean."""
    u, s, vt = np.linalg.svd(v, full_matrices=False)
    mean = v.mean(axis=(-2, -1))[..., None]
    w, h = (np.ones((*v.shape[:-2], *size)) * mean[..., None] for size in ((v.shape[-2], k), (k, v.shape[-1])))
    norm = lambda x: np.linalg.norm(x, axis=-1, keepdims=True)
    for i in range(min(k, s.shape[-1])):
        x, y = u[..., i], vt[..., i, :]
        (x, y), (p, q) = ((np.maximum(g * x, 0), np.maximum(g * y, 0)) for g in (1, -1))
        first = norm(x) * norm(y) >= norm(p) * norm(q)
        x, y = np.where(first, x, p), np.where(first, y, q)
        a, b = norm(x), norm(y)
        there = a * b > 0
        scale, a, b = np.sqrt(s[..., i, None] * a * b), np.where(there, a, 1.0), np.where(there, b, 1.0)
        w[..., i], h[..., i, :] = np.where(there & (x > 0), scale * x / a, mean), np.where(there & (y > 0), scale * y / b, mean)
    return np.maximum(w, EPS), np.maximum(h, EPS)


def factorize(v: np.ndarray, k: int, beta: float = 1.0, steps: int = 50, tolerance: float = 1e-4, rule: Rule | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """w, h and the relative error for one spectrum (bins x frames).

    Without a rule, coordinate descent for the Frobenius loss (beta 2), multiplicative updates for others.
    """
    w, h = start_factors(v, k)
    w, h, _ = local(v.T, w, h.T, rule or (CoordinateDescent() if beta == 2 else Multiplicative(beta)), steps, tolerance)
    return w, h.T, float(np.linalg.norm(v - w @ h.T) / max(np.linalg.norm(v), EPS))


def fit(frames: DataFrame, k: int, beta: float = 1.0, steps: int = 50) -> DataFrame:
    """clip_id, w, h (row by row) and error for the magnitudes (clip_id, t, mag array); one clip is one group, so for short clips; factors.factorize takes long ones."""

    rule = CoordinateDescent() if beta == 2 else Multiplicative(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, (v,) in stacks(batch, "v", also=("n",)):
                v = v.reshape(len(own), batch.column("n")[int(own[0])].as_py(), -1)
                w, h = start_factors(np.ascontiguousarray(v.swapaxes(1, 2)), k)
                w, h, _ = stacked(v, w, h.swapaxes(1, 2), rule, steps, 1e-4)
                error = np.linalg.norm(v - h @ w.swapaxes(1, 2), axis=(1, 2)) / np.maximum(np.linalg.norm(v, axis=(1, 2)), EPS)
                yield pa.record_batch([batch.column("clip_id").take(pa.array(own)), as_lists(w), as_lists(h.swapaxes(1, 2)), pa.array(error)], names=["clip_id", "w", "h", "error"])

    # Clips of one shape are fitted in stacks, each to its own end.
    return packed(frames, length=1 << 31).select("clip_id", "n", "v").mapInArrow(run, "clip_id bigint, w array<double>, h array<double>, error double")


def component_power(w: DataFrame, h: DataFrame) -> DataFrame:
    """clip_id, k, f, t, v: each component's part of the product."""
    return w.join(h, ["clip_id", "k"]).select("clip_id", "k", "f", "t", (F.col("w") * F.col("h")).alias("v"))


def soft_mask(parts: DataFrame, power: float = 2.0) -> DataFrame:
    p = F.pow("v", F.lit(power))
    return parts.select("clip_id", "k", "f", "t", (p / (F.sum(p).over(Window.partitionBy("clip_id", "f", "t")) + EPS)).alias("m"))


def hard_mask(parts: DataFrame) -> DataFrame:
    """1 for the largest component of a cell, of equals the first; rounding decides near ties alike everywhere."""
    best = F.max(F.struct(F.round("v", 9).alias("v"), (-F.col("k")).alias("before"))).over(Window.partitionBy("clip_id", "f", "t"))
    return parts.select("clip_id", "k", "f", "t", (-best["before"] == F.col("k")).cast("double").alias("m"))


def median_mask(mask: DataFrame, kernel: int) -> DataFrame:
    """Median over time, zeros beyond the ends, an even kernel made odd, clipped to [0, 1]."""
    half = (kernel + (kernel % 2 == 0)) // 2
    near = F.collect_list("m").over(Window.partitionBy("clip_id", "k", "f").orderBy("t").rowsBetween(-half, half))
    padded = F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), F.lit(2 * half + 1) - F.size(near))))
    return mask.select("clip_id", "k", "f", "t", clip(F.element_at(padded, half + 1)).alias("m"))


def gated_mask(mask: DataFrame, floor: float, width: float) -> DataFrame:
    m = F.col("m")
    return mask.withColumn("m", m * sigmoid((m - floor) / (width + 1e-8)))


def refine(mask: DataFrame, kernel: int, floor: float, width: float) -> DataFrame:
    return gated_mask(median_mask(mask, kernel), floor, width)


def masked(frames: DataFrame, mask: DataFrame) -> DataFrame:
    """k, clip_id, f, t, re, im: the cells of a spectrum (clip_id, t, k, re, im) under each component's mask."""
    return mask.join(frames.select("clip_id", "t", F.col("k").alias("f"), "re", "im"), ["clip_id", "t", "f"]).select("k", "clip_id", "f", "t", (F.col("re") * F.col("m")).alias("re"), (F.col("im") * F.col("m")).alias("im"))


def separated(cells: DataFrame, mask: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """clip_id, k, n, x: one signal for each component, its mask laid over the spectrum and transformed back."""
    by = ("clip_id", "k")
    return istft(framed(masked(cells, mask), by), n_fft, hop, by)


def _masks(parts: np.ndarray, there: np.ndarray, kind: str, power: float, kernel: int, floor: float, width: float) -> np.ndarray:
    """Refined masks of parts (sources x frames x bins) for the frames that kernel // 2 neighbours surround; there says which frames exist."""
    if kind == "soft":
        p = parts**power
        mask = p / (p.sum(axis=0) + EPS)
    elif kind == "hard":
        mask = (np.round(parts, 9).argmax(axis=0)[None] == np.arange(len(parts))[:, None, None]).astype(float)
    else:
        raise ValueError(f"no mask named {kind}")
    near = np.lib.stride_tricks.sliding_window_view(mask * there[None, :, None], kernel, axis=1)
    smooth = np.clip(np.median(near, axis=-1), 0, 1)
    return smooth / (1 + np.exp(-(smooth - floor) / (width + 1e-8)))


def masked_frames(frames: DataFrame, w: DataFrame, h: DataFrame, mask: str = "soft", power: float = 2.0, kernel: int = 5, floor: float = 0.1, width: float = 0.05, length: int = CHUNK) -> DataFrame:
    """clip_id, k, t, re, im: the frames (clip_id, t, re, im) under the refined mask of each source.

    w (clip_id, f, k, w) and h (clip_id, k, t, h) are the sources' factors.  A mask
    follows from the spectra of a clip and the activations of a frame and its
    neighbours, so chunks of frames take those along, and no cell is a row.
    """
    kernel += kernel % 2 == 0
    half = kernel // 2
    array = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])
    by_clip = w.groupBy("clip_id").agg(array(["f", "k"], "w").alias("w"), (F.max("k") + 1).alias("sources"))
    by_frame = h.groupBy("clip_id", "t").agg(array(["k"], "h").alias("h"))
    # A frame goes to its own chunk, and near a border to the next one as well.
    near = by_frame.withColumn("chunk", F.explode(F.sequence(F.expr(f"greatest(t - {half}, 0) div {length}"), F.expr(f"(t + {half}) div {length}"))))
    near = near.groupBy("clip_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("t", "h"))).alias("c"))
    near = near.select("clip_id", "chunk", F.transform("c", lambda x: x["t"].cast("double")).alias("at"), F.flatten(F.transform("c", lambda x: x["h"])).alias("h"))
    own = frames.groupBy("clip_id", F.expr(f"t div {length}").cast("bigint").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("t", "re", "im"))).alias("c"))
    part = lambda c: F.flatten(F.transform("c", lambda x: x[c])).alias(c)
    own = own.select("clip_id", "chunk", F.transform("c", lambda x: x["t"].cast("double")).alias("t"), part("re"), part("im"))
    key = frames.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, (t, re, im, at, gains, spectra) in rows_of(batches, "t", "re", "im", "at", "h", "w"):
            sources = batch.column("sources")[i].as_py()
            first = batch.column("chunk")[i].as_py() * length - half
            n, where = len(t), at.astype(int) - first
            there, near_h = np.zeros(n + 2 * half), np.zeros((n + 2 * half, sources))
            inside = where < len(there)
            there[where[inside]], near_h[where[inside]] = 1, gains.reshape(-1, sources)[inside]
            parts = near_h.T[:, :, None] * spectra.reshape(-1, sources).T[:, None, :]
            m = _masks(parts, there, mask, power, kernel, floor, width)
            bins = m.shape[2]
            edges = pa.array(np.arange(0, (sources * n + 1) * bins, bins, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array((m * x.reshape(n, bins)[None]).ravel())) for x in (re, im)]
            keys = [batch.column("clip_id").take(pa.array(np.full(sources * n, i))), pa.array(np.repeat(np.arange(sources, dtype=np.int32), n)), pa.array(np.tile(t.astype(np.int32), sources))]
            yield pa.record_batch([*keys, *lists], names=["clip_id", "k", "t", "re", "im"])

    return own.join(near, ["clip_id", "chunk"]).join(by_clip, "clip_id").mapInArrow(run, f"clip_id {key}, k int, t int, re array<double>, im array<double>")


def resynthesized(cells: DataFrame, w: DataFrame, h: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """clip_id, n, x: the product of the factors with the phase of the spectrum, transformed back."""
    spectrum = cells.select("clip_id", "t", F.col("k").alias("f"), *(c.alias(n) for c, n in zip(unit_phase(F.col("re"), F.col("im")), ("re", "im"))))
    out = product(w, h).join(spectrum, ["clip_id", "t", "f"]).select("clip_id", "t", "f", (F.col("vhat") * F.col("re")).alias("re"), (F.col("vhat") * F.col("im")).alias("im"))
    return istft(framed(out), n_fft, hop)


def change(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """clip_id and the norm of what a step has changed over the norm before it."""
    both = before.join(after.withColumnRenamed(value, "_after"), keys)
    square = lambda x: F.sqrt(F.sum(x * x))
    return both.groupBy("clip_id").agg((square(F.col("_after") - F.col(value)) / F.greatest(square(F.col(value)), F.lit(EPS))).alias("change"))


def condition(measured: DataFrame, name: str, rate: int) -> DataFrame:
    """Rows of measures under the name of a condition and its sample rate."""
    return measured.select(F.lit(name).alias("condition"), F.lit(rate).alias("sample_rate"), "*")
