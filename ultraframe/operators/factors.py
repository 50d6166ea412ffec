"""Non-negative factors of many spectra at once, of clips of any length.

The frames of a clip are packed into chunks.  A chunk holds magnitudes v
(frames x bins) and activations h (frames x k); the spectra w (bins x k) of a
clip are one row.  A step takes w to the chunks, renews h there, and sends sums
of bins x k numbers back, which a tree adds up clip by clip and of which the
next w is made.  Magnitudes are written once, in buckets of clip and chunk, so
no step moves them, and a long clip is as many rows as it has chunks.

After each step the state is written to the shared folder and the one before
it is deleted.  Clips that have converged leave the working set with the
factors they have.  Rules take stacks of clips or of chunks of one shape, so that
NumPy is called for a stack and not for a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Written, write, write_bucketed

EPS = 1e-10
#: Frames of a chunk, and chunks (or sums of them) that one task adds up.
CHUNK, ARITY = 256, 32
#: Steps between two looks at the loss of multiplicative updates.
LOOK = 10

Factor = Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Numbers of a stack of rows that NumPy takes at once.
STACK = 1 << 20


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


class Normalized:
    """Kullback-Leibler updates: h, then w, whose columns then get norm 1; ends when neither factor changes by more than the tolerance."""

    w_first = False

    def renew_h(self, v: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        q = v / np.maximum(h @ _t(w), EPS)
        return np.maximum(h * (q @ w) / (w.sum(axis=-2, keepdims=True) + EPS), EPS)

    def sums(self, v: np.ndarray, w: np.ndarray, h: np.ndarray, old: np.ndarray) -> list[np.ndarray]:
        q = v / np.maximum(h @ _t(w), EPS)
        return [_t(q) @ h, h.sum(axis=-2), (h * h).sum(axis=-2), (h * old).sum(axis=-2), (old * old).sum(axis=-2)]

    def renew_w(self, w: np.ndarray, s: list[np.ndarray], note: np.ndarray, step: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        up, down, new, both, old = s
        after = np.maximum(w * up / (down[..., None, :] + EPS), EPS)
        norm = np.sqrt((after * after).sum(axis=-2)) + EPS
        after = after / norm[..., None, :]
        change_w = np.linalg.norm(after - w, axis=(-2, -1)) / (np.linalg.norm(w, axis=(-2, -1)) + EPS)
        change_h = np.sqrt(np.maximum((norm * norm * new - 2 * norm * both + old).sum(axis=-1), 0.0)) / (np.sqrt(old.sum(axis=-1)) + EPS)
        return after, norm, np.stack([change_w, change_h], axis=-1), (change_w < tolerance) & (change_h < tolerance)


class Multiplicative:
    """Updates for a beta loss (2 Frobenius, 1 Kullback-Leibler, 0 Itakura-Saito): w, then h; ends when the loss falls by less than the tolerance of the first in LOOK steps."""

    w_first = True

    def __init__(self, beta: float = 1.0):
        self.beta = beta
        self.power = 1 / (2 - beta) if beta < 1 else 1 / (beta - 1) if beta > 2 else 1.0

    def _parts(self, v: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vh = np.maximum(h @ _t(w), EPS)
        return v * vh ** (self.beta - 2), vh ** (self.beta - 1)

    def renew_h(self, v: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        up, down = self._parts(v, w, h)
        return h * ((up @ w) / np.maximum(down @ w, EPS)) ** self.power

    def loss(self, v: np.ndarray, vh: np.ndarray) -> np.ndarray:
        """The divergence of v from vh; for losses of logarithms zeros count as the least number kept."""
        if self.beta == 2:
            return ((v - vh) ** 2).sum(axis=(-2, -1)) / 2
        vh = np.maximum(vh, EPS)
        if self.beta == 1:
            return np.where(v > 0, v * np.log(np.maximum(v, EPS) / vh), 0.0).sum(axis=(-2, -1)) - v.sum(axis=(-2, -1)) + vh.sum(axis=(-2, -1))
        if self.beta == 0:
            q = np.maximum(v, EPS) / vh
            return (q - np.log(q) - 1).sum(axis=(-2, -1))
        b = self.beta
        return ((v**b + (b - 1) * vh**b - b * v * vh ** (b - 1)) / (b * (b - 1))).sum(axis=(-2, -1))

    def sums(self, v: np.ndarray, w: np.ndarray, h: np.ndarray, old: np.ndarray) -> list[np.ndarray]:
        up, down = self._parts(v, w, h)
        return [_t(up) @ h, _t(down) @ h, self.loss(v, h @ _t(w))[..., None]]

    def renew_w(self, w: np.ndarray, s: list[np.ndarray], note: np.ndarray, step: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        error = np.sqrt(2 * np.maximum(s[2][..., 0], 0.0))
        first, last = (note[..., 0], note[..., 1]) if note.shape[-1] else (error, error)
        done = np.zeros(error.shape, bool)
        if step and step % LOOK == 0:
            done, last = (first == 0) | ((last - error) / np.where(first == 0, 1.0, first) < tolerance), error
        return w * (s[0] / np.maximum(s[1], EPS)) ** self.power, np.ones_like(w[..., 0, :]), np.stack([first, last], axis=-1), done


class CoordinateDescent:
    """The Frobenius loss minimized over one component after another, w, then h; ends when the gradients' violation is the tolerance of the first or less."""

    w_first = True

    def sweep(self, x: np.ndarray, gram: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x (rows x k) with each column in turn at its least; gram is k x k, cross rows x k."""
        x, violation = x.copy(), np.zeros(x.shape[:-2])
        for c in range(x.shape[-1]):
            slope = (x @ gram[..., :, c : c + 1])[..., 0] - cross[..., c]
            violation = violation + np.abs(np.where(x[..., c] == 0, np.minimum(slope, 0), slope)).sum(axis=-1)
            own = gram[..., c, c][..., None]
            x[..., c] = np.where(own > 0, np.maximum(x[..., c] - slope / np.where(own > 0, own, 1.0), 0), x[..., c])
        return x, violation

    def renew_h(self, v: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.sweep(h, _t(w) @ w, v @ w)[0]

    def sums(self, v: np.ndarray, w: np.ndarray, h: np.ndarray, old: np.ndarray) -> list[np.ndarray]:
        return [_t(v) @ h, _t(h) @ h, self.sweep(old, _t(w) @ w, v @ w)[1][..., None]]

    def renew_w(self, w: np.ndarray, s: list[np.ndarray], note: np.ndarray, step: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # The violation of a step is that of its w, noted a step ago, and of its h.
        after, violation = self.sweep(w, s[1], s[0])
        first, of_w = (note[..., 0], note[..., 1]) if note.shape[-1] else (np.zeros_like(violation), np.zeros_like(violation))
        whole = of_w + s[2][..., 0]
        first = whole if step == 1 else first
        return after, np.ones_like(w[..., 0, :]), np.stack([first, violation], axis=-1), (whole <= tolerance * first) & bool(step)


Rule = Normalized | Multiplicative | CoordinateDescent
#: Rules by the name of their solver and loss.
RULES: dict[str, Callable[[], Rule]] = {"normalized": Normalized, "kullback-leibler": lambda: Multiplicative(1.0), "itakura-saito": lambda: Multiplicative(0.0), "frobenius": CoordinateDescent, "frobenius-mu": lambda: Multiplicative(2.0)}


def shapes(rule: Rule, bins: int, k: int) -> list[tuple[int, ...]]:
    """Shapes of what a rule sums up over the frames of a clip."""
    v, w, h = np.zeros((1, bins)), np.ones((bins, k)), np.ones((1, k))
    return [s.shape for s in rule.sums(v, w, h, h)]


def unpacked(flat: np.ndarray, parts: list[tuple[int, ...]]) -> list[np.ndarray]:
    """A stack of rows of numbers as stacks of arrays of these shapes."""
    edges = np.cumsum([int(np.prod(p)) for p in parts])
    return [x.reshape(len(flat), *p) for x, p in zip(np.split(flat, edges[:-1], axis=1), parts)]


def local(v: np.ndarray, w: np.ndarray, h: np.ndarray, rule: Rule, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """w (bins x k), h (frames x k) and the steps taken for the spectrum v (frames x bins) of one clip."""
    w, h, taken = stacked(v[None], w[None], h[None], rule, steps, tolerance)
    return w[0], h[0], int(taken[0])


def stacked(v: np.ndarray, w: np.ndarray, h: np.ndarray, rule: Rule, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w, h and the steps taken for each of a stack of spectra of one shape; each ends by itself."""
    note, at = np.zeros((len(v), 0)), np.arange(len(v))
    ws, hs, taken = np.array(w, float), np.array(h, float), np.full(len(v), steps)
    if rule.w_first and steps:
        w, _, note, _ = rule.renew_w(w, rule.sums(v, w, h, h), note, 0, tolerance)
    for step in range(1, steps + 1):
        old, h = h, rule.renew_h(v, w, h)
        after, scale, note, done = rule.renew_w(w, rule.sums(v, w, h, old), note, step, tolerance)
        ends = done | (step == steps)
        w, h = (np.where(ends[:, None, None], w, after), h) if rule.w_first else (after, h * scale[:, None, :])
        if ends.any():
            ws[at[ends]], hs[at[ends]], taken[at[ends]] = w[ends], h[ends], step
            v, w, h, note, at = (x[~ends] for x in (v, w, h, note, at))
        if not len(at):
            break
    return ws, hs, taken


def packed(frames: DataFrame, value: str = "mag", length: int = CHUNK) -> DataFrame:
    """clip_id, chunk, n, v: the frames (clip_id, t from 0, an array of magnitudes) of a clip, length in a row."""
    rows = frames.groupBy("clip_id", F.expr(f"t div {length}").cast("bigint").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).alias("v")))).alias("c"))
    return rows.select("clip_id", "chunk", F.size("c").alias("n"), F.flatten(F.transform("c", lambda x: x["v"])).alias("v"))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    """Each row of each batch as arrays of numbers."""
    for batch in batches:
        own = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield batch, i, [np.asarray(c[i].values, dtype=np.float64) for c in own]


def stacks(batch: pa.RecordBatch, *columns: str, also: tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of a batch, as places, whose arrays have the same lengths and whose columns of also are the same, with the arrays stacked."""
    lists = [batch.column(c) for c in columns]
    starts = [np.asarray(x.offsets)[:-1] for x in lists]
    values = [np.asarray(x.values, dtype=np.float64) for x in lists]
    kinds = np.column_stack([*(np.diff(np.asarray(x.offsets)) for x in lists), *(np.asarray(batch.column(c)) for c in also)]).astype(np.int64)
    kinds, which = np.unique(kinds, axis=0, return_inverse=True)
    for i, kind in enumerate(kinds):
        sizes = kind[: len(columns)]
        places, most = np.flatnonzero(which.ravel() == i), max(1, STACK // max(1, int(sizes.sum())))
        for first in range(0, len(places), most):
            own = places[first : first + most]
            yield own, [v[s[own][:, None] + np.arange(n)] for v, s, n in zip(values, starts, sizes)]


def as_lists(rows: np.ndarray) -> pa.Array:
    """A stack of arrays as a column of lists."""
    rows = np.ascontiguousarray(rows, dtype=np.float64).reshape(len(rows), -1) if rows.size else np.zeros((len(rows), 0))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _out(batch: pa.RecordBatch, places: np.ndarray, keys: tuple[str, ...], **columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch([*(batch.column(c).take(pa.array(places)) for c in keys), *columns.values()], names=[*keys, *columns])


def summed(parts: DataFrame) -> DataFrame:
    """clip_id and the sum of s over the rows (clip_id, chunk, s) of each clip, ARITY rows at a time, in the order of chunks."""
    add = lambda a, b: F.zip_with(a, b["s"], lambda x, y: x + y)
    last = parts.agg(F.max("chunk")).first()[0] or 0
    while True:
        near = parts.groupBy("clip_id", F.expr(f"chunk div {ARITY}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("c"))
        parts = near.select("clip_id", "chunk", F.aggregate(F.slice("c", 2, ARITY), F.col("c")[0]["s"], add).alias("s"))
        last //= ARITY
        if last == 0:
            return parts.select("clip_id", "s")


def factorize(frames: DataFrame, k: int, spectra: Factor, gains: Factor, rule: Rule | None = None, steps: int = 50, tolerance: float = 1e-4, value: str = "mag", length: int = CHUNK, buckets: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """w (clip_id, f, k, w), h (clip_id, k, t, h) and clips (clip_id, steps) for the frames (clip_id, t, value) of all clips.

    spectra and gains give the start from the places (f, k) and (t, k).  A rule
    of None is Normalized.  Each clip ends by itself; steps, at least 1, is what it has taken.
    """
    if steps < 1:
        raise ValueError("at least one step")
    rule, spark = rule or Normalized(), frames.sparkSession
    key = frames.schema["clip_id"].dataType.simpleString()
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = write_bucketed(packed(frames, value, length), ["clip_id", "chunk"], buckets)

    def start_h(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, _ in stacks(batch, also=("n",)):
                n = batch.column("n")[int(own[0])].as_py()
                t = np.asarray(batch.column("chunk"))[own][:, None] * length + np.arange(n)
                yield _out(batch, own, ("clip_id", "chunk"), h=as_lists(np.asarray(gains(t.reshape(-1, 1), np.arange(k)[None, :])).reshape(len(own), -1)))

    def start_w(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, _ in stacks(batch, also=("bins",)):
                w = spectra(np.arange(batch.column("bins")[int(own[0])].as_py())[:, None], np.arange(k)[None, :]).ravel()
                yield _out(batch, own, ("clip_id",), w=as_lists(np.tile(w, (len(own), 1))), scale=as_lists(np.ones((len(own), k))), note=as_lists(np.zeros((len(own), 0))))

    def chunks(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, (v, w, h, scale) in stacks(batch, "v", "w", "h", "scale"):
                    h = h.reshape(len(own), -1, k) * scale[:, None, :]
                    v, w = v.reshape(*h.shape[:2], -1), w.reshape(len(own), -1, k)
                    new = h if first else rule.renew_h(v, w, h)
                    s = np.concatenate([x.reshape(len(own), -1) for x in rule.sums(v, w, new, h)], axis=1)
                    yield _out(batch, own, ("clip_id", "chunk"), h=as_lists(new), s=as_lists(s))

        return run

    def renewed(step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, (w, s, note) in stacks(batch, "w", "s", "note"):
                    w = w.reshape(len(own), -1, k)
                    after, scale, note, done = rule.renew_w(w, unpacked(s, shapes(rule, w.shape[1], k)), note, step, tolerance)
                    last = (done | (step == steps)) & (step > 0)
                    if rule.w_first:  # h belongs to the w that it was made with
                        after = np.where(last[:, None, None], w, after)
                    yield _out(batch, own, ("clip_id",), w=as_lists(after), scale=as_lists(scale), note=as_lists(note), done=pa.array(last))

        return run

    arrays = f"clip_id {key}, w array<double>, scale array<double>, note array<double>"
    places = v.frame.select("clip_id", "chunk", "n", F.expr("size(v) div n").alias("bins"))
    h = write(places.mapInArrow(start_h, f"clip_id {key}, chunk bigint, h array<double>"))
    w = write(places.where("chunk = 0").mapInArrow(start_w, arrays).withColumn("done", F.lit(False)))
    ended: list[DataFrame] = []
    for step in range(0 if rule.w_first else 1, steps + 1):
        working = w.frame.where("not done").drop("done")
        joined = v.frame.select("clip_id", "chunk", "v").join(h.frame.join(working, "clip_id"), ["clip_id", "chunk"])
        state = write(joined.mapInArrow(chunks(step == 0), f"clip_id {key}, chunk bigint, h array<double>, s array<double>"))
        total = summed(state.frame.select("clip_id", "chunk", "s"))
        after = write(total.join(working, "clip_id").mapInArrow(renewed(step), f"{arrays}, done boolean"))
        w.drop()
        h.drop()
        w, h = after, Written(state.frame.select("clip_id", "chunk", "h"), state.path)
        left = w.frame.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open")).first()
        if left.done or not left.open:
            ended.append(write(h.frame.join(w.frame.where("done").select("clip_id", "w", "scale"), "clip_id").withColumn("steps", F.lit(step))).frame)
        if not left.open:
            break
    for used in (v, w, h):
        used.drop()
    found = reduce(DataFrame.union, ended)
    one = found.where("chunk = 0")
    place = lambda size: [F.expr(f"at div {size}").cast("int"), F.expr(f"at % {size}").cast("int")]
    f, c = place(k)
    ws = one.select("clip_id", F.posexplode("w").alias("at", "w")).select("clip_id", f.alias("f"), c.alias("k"), "w")
    hs = found.select("clip_id", "chunk", F.posexplode("h").alias("at", "h"), "scale")
    hs = hs.select("clip_id", c.alias("k"), (F.col("chunk") * length + f).cast("int").alias("t"), (F.col("h") * F.get("scale", c)).alias("h"))
    return ws, hs, one.select("clip_id", "steps")
