"""Recordings as blocks against the same recordings as one array, and percentiles by counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ultraframe.operators import counted, long, spectral


def clips(spark, *signals):
    return spark.createDataFrame([(i, 0, None if x is None else [float(v) for v in x]) for i, x in enumerate(signals)], "clip_id bigint, class int, samples array<double>")


SIGNALS = [np.random.default_rng(i).standard_normal(n) for i, n in enumerate((100, 99, 17, 16, 15, 1, 200))]


@pytest.mark.parametrize("pad", ["none", "constant"])
@pytest.mark.parametrize("length", [1, 7, 16, 33, 500])
def test_frames_for_every_block_length(spark, length, pad):
    whole = clips(spark, *SIGNALS, [], None)
    want = {(r.clip_id, r.t): (r.re, r.im) for r in spectral.stft(whole, 16, 4, pad).collect()}
    got = {(r.clip_id, r.t): (r.re, r.im) for r in long.stft(long.blocks(whole, length), length, 16, 4, pad).collect()}
    want = {k: v for k, v in want.items() if k[0] < len(SIGNALS)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_hop_longer_than_a_block_and_odd_frames(spark):
    whole = clips(spark, SIGNALS[6])
    for n_fft, hop, length in ((10, 13, 5), (9, 2, 4)):
        want = [(r.t, r.re) for r in spectral.stft(whole, n_fft, hop).orderBy("t").collect()]
        got = [(r.t, r.re) for r in long.stft(long.blocks(whole, length), length, n_fft, hop).orderBy("t").collect()]
        assert [t for t, _ in got] == [t for t, _ in want] and all(np.allclose(a, b) for (_, a), (_, b) in zip(got, want))
    with pytest.raises(ValueError):
        long.stft(whole, 4, 8, 2, "reflect")


def test_blocks_take_just_what_they_lack(spark):
    cut = long.overlapped(long.blocks(clips(spark, np.arange(25)), 10), 10, 3, 12).orderBy("first").collect()
    assert [(r["first"], r.n, r.start, r.samples) for r in cut] == [(0, 10, 0, list(range(22))), (10, 10, 7, list(range(7, 25))), (20, 5, 17, list(range(17, 25)))]


def resampled(spark, x, rate, to, length=37):
    return {r.clip_id: np.array(r.samples) for r in long.whole(long.resample(long.blocks(clips(spark, x), length), length, rate, to)).collect()}[0]


@pytest.mark.parametrize("rate,to", [(96, 44), (44, 96), (100, 100), (3, 1), (1, 3)])
def test_tones_keep_their_pitch_and_level(spark, rate, to):
    n, f = 900, 0.2 * min(rate, to)
    y = resampled(spark, np.sin(2 * np.pi * f * np.arange(n) / rate), rate, to)
    assert len(y) == n * to // rate
    inner = slice(len(y) // 5, -len(y) // 5)
    want = np.sin(2 * np.pi * f * np.arange(len(y)) / to)
    assert np.abs(y - want)[inner].max() < 2e-3


def test_tones_beyond_the_new_band_vanish(spark):
    n = 2000
    for f in (30, 36, 45):  # of a band that ends at 24
        y = resampled(spark, np.sin(2 * np.pi * f * np.arange(n) / 96), 96, 48)
        assert np.abs(y)[100:-100].max() < 2e-3  # -54 dB


@pytest.mark.parametrize("length", [1, 8, 64, 1000])
def test_block_length_changes_nothing(spark, length):
    x = SIGNALS[6]
    assert np.allclose(resampled(spark, x, 32, 20, length), resampled(spark, x, 32, 20, 41))


@pytest.mark.parametrize("q,bins", [(0.0, 4096), (0.1, 4096), (0.999, 64), (1.0, 16)])
def test_percentiles_by_counting(spark, q, bins):
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(size=500) * 30,
        "ties": rng.integers(-2, 3, 300).astype(float),
        "one": np.array([3.5]),
        "same": np.full(50, -7.25),
        "near": 1 + rng.integers(0, 50, 200) * 2.0**-50,
        "far": np.array([-1e200, -1e-200, 0.0, 1e-300, 1e200]),
    }
    odd = [("odd", None), ("odd", float("nan")), ("odd", float("inf")), ("normal", None)]
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + odd
    frame = spark.createDataFrame(rows, "g string, x double").repartition(6)
    coarse = F.floor(F.when(F.abs("x") < 1e15, F.col("x") * 4).otherwise(F.signum("x") * 1e17))
    found = {r.g: r.value for r in counted.percentiles(frame, ["g"], q, coarse, bins=bins).collect()}
    assert found.keys() == groups.keys()
    assert all(np.isclose(found[g], np.percentile(v, 100 * q), rtol=1e-12, atol=0) for g, v in groups.items())


def test_no_values(spark):
    assert counted.percentiles(spark.createDataFrame([], "g string, x double"), ["g"], 0.5, F.floor("x")).count() == 0


def percentiles_of(spark, groups, q, chunk=None):
    """Percentiles by counting, of rows of numbers or of arrays of so many numbers."""
    rows = [(g, v if chunk else float(v)) for g, values in groups.items() for v in ([[float(x) for x in values[i : i + chunk]] for i in range(0, len(values), chunk)] if chunk else values)]
    frame = spark.createDataFrame(rows, f"g bigint, x {'array<double>' if chunk else 'double'}").repartition(3)
    return {r.g: r.value for r in counted.percentiles(frame, ["g"], q, F.floor(F.col("x") * 32) if not chunk else None).collect()}


def test_counts_are_far_fewer_than_the_values(spark, monkeypatch):
    """Of many short clips too, whose values are all different."""
    groups, seen, chosen = {g: np.random.default_rng(g).uniform(-120, 0, 117) for g in range(40)}, [], counted._chosen
    monkeypatch.setattr(counted, "_chosen", lambda table, keys, *more: seen.append(table.count()) or chosen(table, keys, *more))
    found = percentiles_of(spark, groups, 0.1)
    assert all(np.isclose(found[g], np.percentile(v, 10), rtol=1e-12) for g, v in groups.items())
    assert 0 < max(seen) <= 40 * 117 / 4


@pytest.mark.parametrize("chunk", [None, 9])
@pytest.mark.parametrize("groups_sent", [0, 10_000])
def test_percentiles_of_groups_of_all_sizes(spark, monkeypatch, chunk, groups_sent):
    """Dealt out with their values and sent to all tasks; those of over 150 values are large."""
    monkeypatch.setattr(counted, "GROUPS", groups_sent)
    monkeypatch.setattr(counted, "VALUES", 150)
    groups = {n: np.random.default_rng(n).choice([-3.0, 7.5, 8.0], n) if n % 3 == 0 else np.random.default_rng(n).normal(size=n) * 9 for n in (*range(1, 40), 117, 150, 151, 900, 901)}
    for q in (0.1, 0.5):
        found = percentiles_of(spark, groups, q, chunk)
        assert found.keys() == groups.keys()
        assert all(np.isclose(found[g], np.percentile(v, 100 * q), rtol=1e-12, atol=1e-12) for g, v in groups.items())
