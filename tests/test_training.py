"""Training by batches against plain NumPy, going on from a saved model, scoring, and convolution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ultraframe.operators import batches, pooling


def rows(n=240, width=3, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, width)) + 3 * np.eye(classes, width)[y]
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(c), i % 4 != 0) for i, (v, c) in enumerate(zip(x, y))], "id long, x array<double>, y int, is_train boolean").repartition(5)


def restated(x, y, batch_of, classes, n_batches, epochs, rate):
    """Adam over the mean gradient of each batch."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, m, v, t = (np.zeros((a.shape[1], classes)) for _ in range(3)), 0, 0, 0
    w = next(w)
    train = np.arange(len(x)) % 4 != 0
    for epoch in range(1, epochs + 1):
        for b in range(n_batches):
            own = np.array([train[i] and batch_of(i, epoch) == b for i in range(len(x))])
            z = a[own] @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = a[own].T @ (p - np.eye(classes)[y[own]]) / own.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def batch_of(i, epoch, seed=42, n=3):
    import hashlib

    return int(hashlib.md5(f"{seed}|{epoch}|{i}".encode()).hexdigest()[:8], 16) % n


def same(a, b):
    return all(x[c] == pytest.approx(y[c]) for x, y in zip(a, b, strict=True) for c in y)


def test_equals_numpy_and_goes_on_from_a_saved_model(spark, tmp_path):
    x, y = rows()
    own, path = frame(spark, x, y), str(tmp_path / "model")
    whole, log = batches.train(own, "id", "x", "y", 3, 3, 4, 0.05)
    assert np.allclose(whole.weights, restated(x, y, batch_of, 3, 3, 4, 0.05)) and whole.steps == 12
    half, first = batches.train(own, "id", "x", "y", 3, 3, 2, 0.05, save_to=path)
    assert any(e["saved"] for e in first) and same(first, log[:2])
    batches.save(spark, half, path, 2, max(e["accuracy"] for e in first))
    model, epoch, best = batches.load(spark, path)
    again, second = batches.train(own, "id", "x", "y", 3, 3, 2, 0.05, start=model, best=best, first=epoch + 1)
    assert np.allclose(again.weights, whole.weights) and same(second, log[2:])
    assert log[-1]["loss"] < log[0]["loss"] and log[-1]["accuracy"] > 0.8


def test_saved_is_the_best_so_far(spark, tmp_path):
    x, y = rows(seed=3)
    path = str(tmp_path / "model")
    _, log = batches.train(frame(spark, x, y), "id", "x", "y", 3, 3, 3, 0.5, save_to=path)
    _, epoch, best = batches.load(spark, path)
    assert best == max(e["accuracy"] for e in log) and epoch == next(e["epoch"] for e in log if e["accuracy"] == best)


def test_scores_in_batches_equal_scores_at_once(spark, tmp_path):
    x, y = rows(50)
    path = str(tmp_path / "model")
    model = batches.Softmax(np.random.default_rng(1).normal(size=(4, 3)), np.zeros((4, 3)), np.zeros((4, 3)))
    batches.save(spark, model, path)
    found = {r.id: r.s for r in frame(spark, x, y).select("id", batches.scorer(path, 3, 7)("x").alias("s")).collect()}
    assert np.allclose([found[i] for i in range(50)], batches.probabilities(x, model.weights))


def test_many_partitions_are_added_up_in_steps(spark):
    x, y = rows(300)
    w = np.random.default_rng(2).normal(size=(4, 3))
    many = frame(spark, x, y).repartition(150)
    assert np.allclose(batches._sums(many, w), batches._sums(many.coalesce(1), w))


def test_nothing_to_train_with(spark):
    empty = spark.createDataFrame([], "id long, x array<double>, y int, is_train boolean")
    with pytest.raises(ValueError):
        batches.train(empty, "id", "x", "y", 3, 3, 1)
    assert batches.evaluate(empty.select("x", "y"), np.zeros((4, 3))) == (0, 0.0)


def test_convolution_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(2, 5, 4)), rng.normal(size=(3, 3, 2, 3))
    cells = spark.createDataFrame([(0, t, k, c, float(v)) for (c, t, k), v in np.ndenumerate(x)], "clip_id long, t int, k int, c int, x double")
    kernel = spark.createDataFrame([(i - 1, j - 1, c, o, float(v)) for (i, j, c, o), v in np.ndenumerate(w)], "dt int, dk int, c int, out int, weight double")
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    want = {(t, k, o): sum(padded[c, t + i, k + j] * w[i, j, c, o] for i in range(3) for j in range(3) for c in range(2)) for t in range(5) for k in range(4) for o in range(3)}
    found = {(r.t, r.k, r.c): r.x for r in pooling.convolved(cells, kernel).collect()}
    assert found.keys() == want.keys() and all(np.isclose(found[p], want[p]) for p in want)


@pytest.mark.parametrize("how", ["avg", "max", "avg+max"])
def test_pooling_in_two_directions(spark, how):
    x = np.random.default_rng(4).normal(size=(5, 7))
    cells = spark.createDataFrame([(0, t, k, 0, float(v)) for (t, k), v in np.ndenumerate(x)], "clip_id long, t int, k int, c int, x double")
    found = {(r.t, r.k): r.x for r in pooling.pooled(cells, 2, 3, how).collect()}
    parts = {(t, k): x[2 * t : 2 * t + 2, 3 * k : 3 * k + 3] for t in range(2) for k in range(2)}
    value = {"avg": np.mean, "max": np.max, "avg+max": lambda p: p.mean() + p.max()}[how]
    assert found.keys() == parts.keys() and all(np.isclose(found[p], value(parts[p])) for p in parts)


def test_frames_in_chunks_equal_cells(spark):
    """A block over chunks shorter than the clips, with neighbours, equals the block over cells."""
    rng = np.random.default_rng(6)
    rows = [(i, t, rng.random(5).tolist()) for i, n in enumerate((1, 4, 9, 13)) for t in range(n)]
    frames = spark.createDataFrame(rows, "clip_id long, t int, mag array<double>").repartition(3)
    kernels = [spark.createDataFrame([(i - 1, j - 1, c, o, float(rng.normal())) for i in range(3) for j in range(3) for c in range(a) for o in range(b)], "dt int, dk int, c int, out int, weight double") for a, b in ((1, 2), (2, 3))]
    cells = frames.selectExpr("clip_id", "t", "posexplode(mag) as (k, x)").selectExpr("clip_id", "t", "k", "0 as c", "x")
    want = {(r.clip_id, r.t, r.k, r.c): r.x for r in pooling.conv_block(cells, kernels).collect()}
    for length in (4, 256):
        found = {(r.clip_id, r.t, r.k, r.c): r.x for r in pooling.conv_frames(frames, kernels, length=length).collect()}
        assert found.keys() == want.keys() and all(np.isclose(found[p], want[p]) for p in want)
