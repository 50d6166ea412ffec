"""Whitening of embeddings by a tall-skinny QR (operator 11).

Entries become whole numbers, so sums are exact, and each distinct vector is
fitted once.  Rows are centred with the exact sums and each partition is
reduced to the triangle R of its QR; triangles are merged a few at a time along
a tree until one is left.  Its right singular vectors are the components; no
covariance is ever formed.  A triangle is dims x dims numbers, whatever the
number of rows, and only the last one reaches the driver.

Vectors that are null or empty, or that hold null or non-finite entries, take no part, nor do
those of another length than most (of equal counts the longer).  Repeated ids
are rows of their own.  Entries beyond the range of a long are cut to it.
Components without variance can't be whitened and are left out; with no rows,
or with one distinct vector, nothing comes out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved, written

STEPS = 256
#: How many triangles one task merges.
ARITY = 16
#: Rows that are centred and reduced at a time.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with exact sums per dimension; directions (a row each), variances and the trace of the covariance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def whole(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with x, their entries as whole steps; those that take no part are gone."""
    c = F.col(column).cast("array<double>")
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(c.isNotNull() & (F.size(c) > 0) & ~odd).withColumn("x", F.transform(c, lambda v: F.floor(v * STEPS)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _sums(distinct: DataFrame) -> list[int]:
    """The exact sum of each dimension: 32 bits at a time in a batch, decimals across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                yield pa.record_batch([pa.array(np.arange(x.shape[1], dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    parts = distinct.select("x").mapInArrow(run, "i int, high bigint, low bigint")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("i").agg(total("high"), total("low")).orderBy("i").collect()  # one for each dimension
    return [(int(r.high) << 32) + int(r.low) for r in rows]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in longs where they suffice, else in Python's integers."""
    if x.size and int(np.abs(x.astype(np.float64)).max()) * n + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _merged(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One array from those of part, m: ARITY neighbours at a time are merged, until one is left."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        arrays = [np.frombuffer(b, dtype=np.float64) for b in table.column("m").to_pylist()]
        return pa.table({"part": table.column("group").slice(0, 1), "m": pa.array([merge(arrays).tobytes()], pa.binary())})

    n = parts.agg(F.max("part")).first()[0]
    if n is None:
        return None
    while n > 0:
        parts = saved(parts.withColumn("group", F.expr(f"part div {ARITY}")).groupBy("group").applyInArrow(run, "part bigint, m binary"))
        n //= ARITY
    return np.frombuffer(parts.first().m, dtype=np.float64)


def _reduced(distinct: DataFrame, one: Callable[[Iterator[np.ndarray]], np.ndarray]) -> DataFrame:
    """part and m: what one makes of the blocks of rows of each partition."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield _matrix(batch.column("x").slice(at, BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = one(blocks(batches))
        if found is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.tobytes()], pa.binary())], names=["part", "m"])

    return saved(distinct.select("x").mapInArrow(run, "part bigint, m binary"))


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def fit(x: DataFrame) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the vectors in x, and its fit list: each distinct vector once; None without vectors."""
    x = x.select("x")
    dims = x.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if dims is None:
        return None
    d = dims.dims
    distinct = written(x.where(F.size("x") == d).distinct())
    n, sums = distinct.count(), _sums(distinct)

    def one(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        r = np.zeros((0, d))
        for block in blocks:
            r = _triangle(np.vstack([r, centred(block, n, sums).astype(np.float64) / n]))
        return r.ravel() if len(r) else None

    r = _merged(_reduced(distinct, one), lambda parts: _triangle(np.vstack([p.reshape(-1, d) for p in parts])).ravel())
    _, s, directions = np.linalg.svd(r.reshape(-1, d), full_matrices=False)
    # Rounding leaves a singular value where there is no variance.
    real = s > s[0] * np.finfo(np.float64).eps * max(n, d) if len(s) and s[0] > 0 else np.zeros(len(s), bool)
    return Whitening(n, sums, directions[real], s[real] ** 2 / n, float((s**2).sum() / n)), distinct


def _projected(model: Whitening, k: int, off: np.ndarray) -> np.ndarray:
    return off.astype(np.float64) / model.n @ model.directions[:k].T / np.sqrt(model.variances[:k])


def identity_error(model: Whitening, distinct: DataFrame, k: int) -> float | None:
    """The largest entry of the whitened fit list's covariance less the identity; moments of partitions are merged along a tree."""
    k = min(k, len(model.variances))
    if not k:
        return None

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Count, means and centred products of two sets as those of both."""
        n, off = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
        products = a[k + 1 :] + b[k + 1 :] + np.outer(off, off).ravel() * (a[0] * b[0] / n)
        return np.concatenate([[n], a[1 : k + 1] + off * (b[0] / n), products])

    def one(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        whole = None
        for block in blocks:
            z = _projected(model, k, centred(block, model.n, model.sums))
            mean = z.mean(axis=0)
            own = np.concatenate([[len(z)], mean, ((z - mean).T @ (z - mean)).ravel()])
            whole = own if whole is None else join(whole, own)
        return whole

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        whole = parts[0]
        for p in parts[1:]:
            whole = join(whole, p)
        return whole

    found = _merged(_reduced(distinct, one), merge)
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = 4, id: str | Column = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component up to k.

    Components are counted from 1 by falling variance.  deviation is the sum of
    (n * x - sums) ** 2.  Columns of vectors other than id and column don't matter.
    """
    x = whole(vectors.select((F.col(id) if isinstance(id, str) else id).alias("vec_id"), F.col(column).alias("v")), "v").select("vec_id", "x")
    key = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {key}, component int, deviation decimal(38,0), whitened double"
    fitted = fit(x)
    if fitted is None or not len(fitted[0].variances):
        empty = x.where("false").select("vec_id", F.lit(0).alias("component"), F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"))
        return _finished(empty, 0, np.zeros(0), None)
    model, distinct = fitted
    error = identity_error(model, distinct, k)
    k = min(k, len(model.variances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.decimal128(38, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                off = centred(_matrix(part.column("x")), model.n, model.sums)
                small = off.dtype != object and (off.astype(np.float64) ** 2).sum(axis=1).max() < 1 << 62
                own = off if small else off.astype(object)
                deviation = pa.array((own * own).sum(axis=1).tolist(), pa.int64()).cast(pa.decimal128(19, 0)).cast(kind) if small else pa.array((own * own).sum(axis=1).tolist(), kind)
                z = _projected(model, k, off)
                again = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.record_batch(
                    [part.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), deviation.take(again), pa.array(z.ravel())],
                    names=["vec_id", "component", "deviation", "whitened"],
                )

    rows = x.where(F.size("x") == len(model.sums)).mapInArrow(run, schema)
    return _finished(rows, model.n, model.variances[:k] / model.trace, error)


def _finished(rows: DataFrame, n: int, explained: np.ndarray, error: float | None) -> DataFrame:
    share = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("component")) if len(explained) else F.lit(None).cast("double")
    return rows.select("vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
