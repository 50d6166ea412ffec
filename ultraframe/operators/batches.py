"""Softmax regression by mini-batches: Adam, epochs with validation, and what is saved on improvement.

Rows are dealt to batches by the hash of their key and of the epoch, so an epoch
has a new order and nothing is sorted.  An epoch's rows are written in a folder
for each batch, and a step reads its own folder only.  Each partition adds up
its rows' gradients; what leaves it is one array of the model's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sources.storage import Written, shared_folder

#: Rates of the moments, and what keeps the division from zero.
MOMENTS, TINY = (0.9, 0.999), 1e-8
#: Sums that one task adds up at a time.
ARITY = 64


@dataclass
class Softmax:
    """weights (width + 1 x classes, the last row a bias), the optimizer's moments and the steps taken."""

    weights: np.ndarray
    mean: np.ndarray = field(default=None)
    square: np.ndarray = field(default=None)
    steps: int = 0

    @classmethod
    def zero(cls, width: int, classes: int) -> Softmax:
        return cls(*(np.zeros((width + 1, classes)) for _ in range(3)))

    def step(self, gradient: np.ndarray, rate: float) -> Softmax:
        """One step of Adam."""
        a, b = MOMENTS
        n = self.steps + 1
        mean, square = a * self.mean + (1 - a) * gradient, b * self.square + (1 - b) * gradient**2
        weights = self.weights - rate * (mean / (1 - a**n)) / (np.sqrt(square / (1 - b**n)) + TINY)
        return Softmax(weights, mean, square, n)


def probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights[:-1] + weights[-1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def batch_of(key: Column, seed: int, epoch: int, n: int) -> Column:
    """A batch below n for a key, another one each epoch."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{epoch}|"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def _sums(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Gradient, then loss, right ones and count, over all rows (x, y)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(weights.size + 3)
        for batch in batches:
            if batch.num_rows:
                x, y = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("y"))
                p = probabilities(x, weights)
                own = p[np.arange(len(y)), y]
                right = (np.round(p, 12).argmax(axis=1) == y).sum()
                p[np.arange(len(y)), y] -= 1
                total += np.concatenate([(x.T @ p).ravel(), p.sum(axis=0), [-np.log(own).sum(), right, len(y)]])
        if total[-1]:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.asarray(b.column("s").flatten()).reshape(b.num_rows, -1).sum(axis=0) for b in batches if b.num_rows]
        if parts:
            yield pa.record_batch([pa.array([np.sum(parts, axis=0)], pa.list_(pa.float64()))], names=["s"])

    parts = rows.select("x", "y").mapInArrow(add, "s array<double>")
    n = parts.rdd.getNumPartitions()
    while n > ARITY:
        n = -(-n // ARITY)
        parts = parts.repartition(n).mapInArrow(merge, "s array<double>")
    return np.sum([r.s for r in parts.collect()] or [np.zeros(weights.size + 3)], axis=0)  # ARITY arrays of the model's size at most


def evaluate(rows: DataFrame, weights: np.ndarray) -> tuple[int, float]:
    """How many rows (x, y) there are, and the share that is right; 0 without rows."""
    s = _sums(rows, weights)
    return int(s[-1]), float(s[-2] / s[-1]) if s[-1] else 0.0


def train(rows: DataFrame, key: str, x: str, y: str, classes: int, n_batches: int, epochs: int, rate: float = 1e-4, seed: int = 42, save_to: str | None = None, start: Softmax | None = None, best: float = 0.0, first: int = 1) -> tuple[Softmax, list[dict]]:
    """The model after the last epoch, and for each epoch its mean loss of batches, accuracies and whether it was saved.

    rows have is_train: others are for validation.  A row counts as right by the
    model before its batch's step.  save_to gets the model whenever validation
    exceeds all before.  start, best and first go on from a saved one.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("int").alias("y"), "is_train")
    held_out = own.where("not is_train")
    width = own.select(F.size("x").alias("n")).first()
    if width is None:
        raise ValueError("no rows to train with")
    model, log = start or Softmax.zero(width.n, classes), []
    for epoch in range(first, first + epochs):
        path = f"{shared_folder(spark)}/epoch-{seed}-{epoch}-{spark.sparkContext.applicationId}"
        own.where("is_train").select("x", "y", batch_of(F.col("key"), seed, epoch, n_batches).alias("batch")).write.mode("overwrite").partitionBy("batch").parquet(path)
        table = Written(spark.read.schema("x array<double>, y int, batch int").parquet(path), path)
        losses, right, n = [], 0, 0
        for batch in range(n_batches):
            s = _sums(table.frame.where(F.col("batch") == batch), model.weights)
            if not s[-1]:
                continue
            losses.append(s[-3] / s[-1])
            right, n = right + int(s[-2]), n + int(s[-1])
            model = model.step(s[:-3].reshape(model.weights.shape) / s[-1], rate)
        table.drop()
        accuracy = evaluate(held_out, model.weights)[1]
        saved = accuracy > best
        best = max(best, accuracy)
        log.append({"epoch": epoch, "loss": float(np.mean(losses)) if losses else 0.0, "train_accuracy": right / n if n else 0.0, "accuracy": accuracy, "saved": saved})
        if saved and save_to:
            save(spark, model, save_to, epoch, best)
    return model, log


def save(spark: SparkSession, model: Softmax, path: str, epoch: int = 0, best: float = 0.0) -> None:
    """Model, moments and where training stands, as one row of Parquet over another one."""
    arrays = [a.ravel().tolist() for a in (model.weights, model.mean, model.square)]
    row = [(*arrays, model.weights.shape[1], model.steps, epoch, best)]
    spark.createDataFrame(row, "weights array<double>, mean array<double>, square array<double>, classes int, steps int, epoch int, best double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Softmax, int, float]:
    """A saved model, its epoch and the accuracy it was saved with."""
    r = spark.read.parquet(path).first()
    return Softmax(*(np.array(a).reshape(-1, r.classes) for a in (r.weights, r.mean, r.square)), r.steps), r.epoch, r.best


def scorer(path: str, width: int, size: int = 4096):
    """A column function of features: the scores by the model saved at path, which each worker reads once.

    path is one that executors reach (local paths and addresses of pyarrow's file systems).
    """
    from pyspark.ml.functions import predict_batch_udf

    def make():
        import pyarrow.dataset as ds

        r = ds.dataset(path.removeprefix("file:"), format="parquet").to_table(columns=["weights", "classes"]).to_pylist()[0]
        weights = np.array(r["weights"]).reshape(-1, r["classes"])
        return lambda x: probabilities(np.asarray(x, dtype=np.float64), weights)

    return predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=size, input_tensor_shapes=[[width]])
