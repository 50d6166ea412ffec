"""Factors of many clips at once against plain NumPy, their stop, and sources end to end."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ultraframe.operators import cluster, factors, separation
from ultraframe.plans.fitted import gains, spectra
from ultraframe.plans.separate import separate
from ultraframe.sources import storage

EPS, BINS = 1e-10, 5


def spectra_of(lengths, seed=0):
    """frames x bins for each clip: a few tones, and noise."""
    rng = np.random.default_rng(seed)
    return {i: np.maximum(rng.random((n, 2)) @ rng.random((2, BINS)) + 0.02 * rng.random((n, BINS)), 0) for i, n in enumerate(lengths)}


def frame(spark, clips):
    return spark.createDataFrame([(i, t, row.tolist()) for i, v in clips.items() for t, row in enumerate(v)], "clip_id bigint, t int, mag array<double>").repartition(5)


def start(n, k):
    return spectra(np.arange(BINS)[:, None], np.arange(k)[None]), gains(np.arange(n)[:, None], np.arange(k)[None])


def normalized(v, k, steps, tolerance):
    """The updates in matrix form, v as bins x frames."""
    w, h = start(v.shape[1], k)
    h = h.T.copy()
    for step in range(1, steps + 1):
        w0, h0 = w.copy(), h.copy()
        h = np.maximum(h * (w.T @ (v / np.maximum(w @ h, EPS)) / (w.sum(0)[:, None] + EPS)), EPS)
        w = np.maximum(w * ((v / np.maximum(w @ h, EPS)) @ h.T / (h.sum(1)[None] + EPS)), EPS)
        norm = np.sqrt((w**2).sum(0)) + EPS
        w, h = w / norm, h * norm[:, None]
        if np.linalg.norm(w - w0) / (np.linalg.norm(w0) + EPS) < tolerance and np.linalg.norm(h - h0) / (np.linalg.norm(h0) + EPS) < tolerance:
            break
    return w, h, step


def descent(v, k, steps):
    """Element by element, each at the least of the loss with all others fixed."""
    w, h = start(v.shape[1], k)
    h = h.T.copy()
    for _ in range(steps):
        for x, y, target in ((w, h, v), (h.T, w.T, v.T)):
            for i in range(len(x)):
                for c in range(k):
                    rest = target[i] - x[i] @ y + x[i, c] * y[c]
                    x[i, c] = max(0.0, rest @ y[c] / (y[c] @ y[c]))
    return w, h


def collected(found, clips, k):
    w, h, ends = found
    ws, hs = {i: np.zeros((BINS, k)) for i in clips}, {i: np.zeros((k, len(v))) for i, v in clips.items()}
    for r in w.collect():
        ws[r.clip_id][r.f, r.k] = r.w
    for r in h.collect():
        hs[r.clip_id][r.k, r.t] = r.h
    return ws, hs, {r.clip_id: r.steps for r in ends.collect()}


@pytest.mark.parametrize("length", [4, 256])
def test_each_clip_stops_by_itself(spark, length):
    """Clips of one frame to many chunks end after as many steps as they do alone, with the same factors."""
    clips = spectra_of([1, 7, 30, 150])
    ws, hs, steps = collected(factors.factorize(frame(spark, clips), 3, spectra, gains, steps=14, tolerance=0.02, length=length), clips, 3)
    assert len(set(steps.values())) > 1
    for i, v in clips.items():
        w, h, n = normalized(v.T, 3, 14, 0.02)
        assert steps[i] == n and np.allclose(ws[i], w, atol=1e-9) and np.allclose(hs[i], h, atol=1e-9)


@pytest.mark.parametrize("name", ["kullback-leibler", "itakura-saito", "frobenius", "frobenius-mu"])
def test_rules_on_chunks_equal_one_clip_alone(spark, name):
    clips = spectra_of([9, 23], 1)
    rule = factors.RULES[name]()
    ws, hs, steps = collected(factors.factorize(frame(spark, clips), 2, spectra, gains, rule, 11, 0.05, length=8), clips, 2)
    for i, v in clips.items():
        w, h, n = factors.local(v, *start(len(v), 2), rule, 11, 0.05)
        assert steps[i] == n and np.allclose(ws[i], w, atol=1e-8) and np.allclose(hs[i], h.T, atol=1e-8)


def test_descent_is_exact_in_each_component():
    for i, v in spectra_of([12, 40], 2).items():
        for steps in (1, 4):
            w, h, _ = factors.local(v, *start(len(v), 3), factors.CoordinateDescent(), steps, 0.0)
            w1, h1 = descent(v.T, 3, steps)
            assert np.allclose(w, w1) and np.allclose(h.T, h1)


def test_descent_is_not_above_multiplicative_updates():
    for v in spectra_of([12, 40, 80], 3).values():
        for steps in (3, 10, 40):  # a first sweep alone can be the worse one
            loss = []
            for rule in (factors.CoordinateDescent(), factors.Multiplicative(2.0)):
                w, h, _ = factors.local(v, *start(len(v), 3), rule, steps, 0.0)
                loss.append(((v - h @ w.T) ** 2).sum())
            assert loss[0] <= loss[1] * (1 + 1e-9)


@pytest.mark.parametrize("beta", [0.0, 0.5, 1.0, 1.5, 2.0, 3.0])
def test_multiplicative_updates_lower_their_loss(beta):
    v = spectra_of([40], 5)[0] + 0.01
    rule, falls = factors.Multiplicative(beta), []
    for steps in (1, 2, 5, 20, 60):
        w, h, _ = factors.local(v, *start(len(v), 3), rule, steps, 0.0)
        falls.append(rule.loss(v, h @ w.T))
    assert all(b <= a + 1e-12 for a, b in zip(falls, falls[1:])) and falls[-1] >= 0


def test_multiplicative_updates_stop_by_their_loss():
    v = spectra_of([40], 6)[0]
    w, h, n = factors.local(v, *start(len(v), 3), factors.Multiplicative(1.0), 500, 1e-3)
    assert n % factors.LOOK == 0 and n < 500


def test_state_is_deleted(spark):
    folder = storage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    clips = spectra_of([9, 23], 1)
    w, h, ends = factors.factorize(frame(spark, clips), 2, spectra, gains, steps=6, tolerance=0.0, length=8)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and ends.count() == 2  # the factors of the clips that ended, all in the last step
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_magnitudes_stay_where_they_are(spark):
    """Only the small side of the join of a step is dealt out anew."""
    left = storage.write_bucketed(spark.range(1000).selectExpr("id % 7 as clip_id", "id as chunk", "id as v"), ["clip_id", "chunk"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = left.frame.join(spark.range(1000).selectExpr("id % 7 as clip_id", "id as chunk", "id as h"), ["clip_id", "chunk"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        left.drop()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_clips(spark):
    w, h, ends = factors.factorize(frame(spark, {}) if False else spark.createDataFrame([], "clip_id bigint, t int, mag array<double>"), 2, spectra, gains, steps=3)
    assert w.count() == h.count() == ends.count() == 0
    with pytest.raises(ValueError):
        factors.factorize(w, 2, spectra, gains, steps=0)


def ward_by_members(x, n):
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > n:
        cost = lambda p: round(len(groups[p[0]]) * len(groups[p[1]]) / (len(groups[p[0]]) + len(groups[p[1]])) * float(((x[groups[p[0]]].mean(0) - x[groups[p[1]]].mean(0)) ** 2).sum()), 9)  # noqa: E731, B023
        i, j = min(((i, j) for i in groups for j in groups if i < j), key=lambda p: (cost(p), p))
        groups[i] += groups.pop(j)
    labels = np.zeros(len(x), int)
    for place, i in enumerate(sorted(groups)):
        labels[groups[i]] = place
    return labels


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_ward_equals_costs_of_members(n):
    rng = np.random.default_rng(n)
    for x in (rng.random((12, 4)), rng.integers(0, 3, (12, 2)).astype(float)):
        assert cluster.ward(x, n).tolist() == ward_by_members(x, n).tolist()


def two_tones(seconds=1.0, rate=2000):
    t = np.arange(int(seconds * rate)) / rate
    low = np.sin(2 * np.pi * 125 * t) * (np.sin(2 * np.pi * 2 * t) > 0)
    high = 0.8 * np.sin(2 * np.pi * 625 * t) * (np.sin(2 * np.pi * 3 * t + 1) > 0)
    return low, high


@pytest.mark.parametrize("method", ["agglomerative", "k-means", "spectral"])
def test_two_tones_come_apart(spark, method):
    low, high = two_tones()
    clips = spark.createDataFrame([(i, 0, (low * a + high).tolist()) for i, a in enumerate((1.0, 0.5))], "clip_id bigint, class int, samples array<double>")
    rng = np.random.default_rng(5)
    table = rng.random((4096, 4)) + 0.1
    pick = lambda x, k: table[x % 4096, k]
    found = separate(clips, 2000, 64, 16, 4, 2, pick, pick, factors.Normalized(), 25, 1e-4, method, 0.6, 16, 8, length=50).where("x is not null").toPandas()
    for i, a in enumerate((1.0, 0.5)):
        one = found[found.clip_id == i].pivot(index="n", columns="k", values="x")
        match = [[np.corrcoef(one[k], s[one.index])[0, 1] for k in (0, 1)] for s in (low * a, high)]
        assert {int(np.argmax(m)) for m in match} == {0, 1} and min(max(m) for m in match) > 0.85


@pytest.mark.parametrize("kind", ["soft", "hard"])
def test_masks_on_chunks_equal_masks_of_cells(spark, kind):
    rng = np.random.default_rng(8)
    n, bins, sources = 23, 4, 3
    w = [(0, f, k, float(v)) for (f, k), v in np.ndenumerate(rng.random((bins, sources)))]
    h = [(0, k, t, float(v)) for (k, t), v in np.ndenumerate(rng.random((sources, n)))]
    re, im = rng.normal(size=(n, bins)), rng.normal(size=(n, bins))
    frames = spark.createDataFrame([(0, t, re[t].tolist(), im[t].tolist()) for t in range(n)], "clip_id bigint, t int, re array<double>, im array<double>")
    ws, hs = spark.createDataFrame(w, "clip_id bigint, f int, k int, w double"), spark.createDataFrame(h, "clip_id bigint, k int, t int, h double")
    parts = separation.component_power(ws, hs)
    mask = separation.refine(separation.soft_mask(parts) if kind == "soft" else separation.hard_mask(parts), 4, 0.1, 0.05)
    cells = frames.select("clip_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c")).select("clip_id", "t", "k", "c.re", "c.im")
    want = {(r.k, r.f, r.t): (r.re, r.im) for r in separation.masked(cells, mask).collect()}
    for length in (1, 5, 100):
        got = {(r.k, f, r.t): (r.re[f], r.im[f]) for r in separation.masked_frames(frames, ws, hs, kind, kernel=4, length=length).collect() for f in range(bins)}
        assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)


@pytest.mark.parametrize("name", ["normalized", "kullback-leibler", "itakura-saito", "frobenius", "frobenius-mu"])
def test_a_stack_is_its_clips_each_to_its_own_end(name):
    rng, rule = np.random.default_rng(8), factors.RULES[name]()
    v = rng.random((6, 13, 2)) @ rng.random((6, 2, BINS)) + 0.01
    w, h = (np.tile(x, (6, 1, 1)) for x in start(13, 2))
    ws, hs, taken = factors.stacked(v, w, h, rule, 200, 0.02)
    for i in range(6):
        alone = factors.local(v[i], w[i], h[i], rule, 200, 0.02)
        assert np.allclose(ws[i], alone[0]) and np.allclose(hs[i], alone[1]) and taken[i] == alone[2]
    assert taken.max() < 200


def test_ward_of_groups_of_several_shapes(spark):
    rng = np.random.default_rng(9)
    groups = {g: rng.random((2 + g % 4, 3 + g % 2)) for g in range(30)}
    rows = [(g, 2 * k, f"f{i}", float(v)) for g, x in groups.items() for (k, i), v in np.ndenumerate(x)]
    found = {(r.group, r.k): r.cluster for r in cluster.cluster_ward(spark.createDataFrame(rows, "group long, k int, i string, x double").repartition(3), 2).collect()}
    assert found == {(g, 2 * k): c for g, x in groups.items() for k, c in enumerate(ward_by_members(x, 2))}
    assert cluster.wards(np.stack([groups[1], groups[5]]), 2).tolist() == [ward_by_members(groups[g], 2).tolist() for g in (1, 5)]
