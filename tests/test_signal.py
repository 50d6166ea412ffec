"""Closed forms, round trips and edge cases of the signal operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ultraframe.functions import names
from ultraframe.functions.scalar import half_even
from ultraframe.operators import activity, cluster, evaluate, framing, pooling, separation, spectral
from ultraframe.operators.factors import Normalized
from ultraframe.sources import audio, tables

SF = "/root/testdata/sf0.001"


def clip(spark, *signals):
    return spark.createDataFrame([(i, 0, [float(v) for v in x]) for i, x in enumerate(signals)], "clip_id bigint, class int, samples array<double>")


@pytest.mark.parametrize("pad", ["none", "constant", "reflect"])
def test_stft_equals_numpy(spark, pad):
    x = np.random.default_rng(1).standard_normal(100)
    got = spectral.stft(clip(spark, x), 32, 8, pad).orderBy("t").toPandas()
    y = x if pad == "none" else np.pad(x, 16, mode=pad)
    want = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, 32)[::8] * spectral.hann(32), axis=1)
    assert np.allclose(np.stack(got["re"]) + 1j * np.stack(got["im"]), want)


def test_short_empty_and_null_clips_have_no_frames(spark):
    c = spark.createDataFrame([(1, 0, [1.0]), (2, 0, []), (3, 0, None)], "clip_id bigint, class int, samples array<double>")
    assert spectral.stft(c, 16, 4).count() == 0


def test_istft_returns_the_signal(spark):
    x = np.random.default_rng(2).standard_normal(128)
    back = spectral.istft(spectral.stft(clip(spark, x), 32, 8), 32, 8).where("x is not null").orderBy("n").toPandas()
    assert np.allclose(back["x"], x[back["n"]]) and len(back) > 100


def test_resample_keeps_a_tone(spark):
    t = np.arange(64) / 64
    got = spectral.resample(clip(spark, np.sin(2 * np.pi * 4 * t)), 64, 128).first()["samples"]
    assert np.allclose(got, np.sin(2 * np.pi * 4 * np.arange(128) / 128), atol=1e-9)


def test_silent_clip_plays_and_has_no_ultrasound(spark):
    db = spectral.decibels(spectral.cells(spectral.stft(clip(spark, np.zeros(64)), 16, 4), 64, 16, 4))
    row = activity.summary(db, 20.0, seconds=0.25).first()
    assert (row["pua_frame"], row["n_ultra_frames"]) == (0.0, 0) and row["n_play_frames"] == 13


def test_no_band_above_the_limit_is_a_status(spark):
    db = spectral.decibels(spectral.cells(spectral.stft(clip(spark, np.ones(64)), 16, 4), 64, 16, 4))
    assert activity.summary(db, 32.0, seconds=0.25).first()["status"] == "no_band"


def test_no_playing_frames_gives_null(spark):
    f = spark.createDataFrame([(1, 0, 0.1, False, True, None)], "clip_id bigint, t int, time_s double, playing boolean, ultra boolean, top_freq double")
    assert activity.share_of_frames(f).first()["pua_frame"] is None
    assert activity.share_of_windows(f, 0.25).first()["pua_sec"] is None


def test_frame_on_the_last_edge_is_in_no_window(spark):
    f = spark.createDataFrame([(1, 0, 0.5, True, False, None), (1, 1, 1.0, True, True, None)], "clip_id bigint, t int, time_s double, playing boolean, ultra boolean, top_freq double")
    assert activity.share_of_windows(f, 1.0).first()["pua_sec"] == 0.0


def test_vote_tie_goes_to_the_first_met(spark):
    p = spark.createDataFrame([(1, i, 2, v) for i, v in enumerate([2, 2, 1, 1])], "file_id bigint, start bigint, label int, pred int")
    assert evaluate.majority_vote(p).first()["pred"] == 2


def test_absent_class_has_a_zero_row_and_no_part_in_macro(spark):
    p = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1, 1)], "file_id bigint, start bigint, label int, pred int")
    labels = spark.createDataFrame([(0,), (1,), (2,)], "class int")
    assert evaluate.macro_scores(p).first()["f1_macro"] == 1.0
    assert evaluate.confusion(p, labels).where("label = 2").agg(F.sum("n")).first()[0] == 0
    assert evaluate.confusion(p, labels).count() == 9


def test_rounding_half_even(spark):
    got = spark.createDataFrame([(0.575,), (0.285,), (0.125,)], "x double").select(half_even(F.col("x")).alias("x")).collect()
    assert [g.x for g in got] == [0.57, 0.28, 0.12]


def test_times(spark):
    d = spark.createDataFrame([("1:05",), ("end",), ("7.5",), ("1:2:3",), (None,)], "t string").select(names.parse_time(F.col("t")).alias("p")).collect()
    assert [(x.p.seconds, x.p.valid) for x in d] == [(65.0, True), (None, True), (7.5, True), (None, False), (None, True)]


@pytest.mark.parametrize("share", [0.0, 0.2, 0.33, 0.9])
def test_split_is_exact(spark, share):
    d = spark.range(1000).withColumnRenamed("id", "clip_id")
    assert framing.exact_split(d, "clip_id", share).where("not is_train").count() == int(share * 1000)


def test_all_quiet_has_no_next(spark):
    levels = framing.level(clip(spark, np.zeros(8), np.zeros(8)))
    assert {r.used for r in framing.next_valid(levels, 0.1).collect()} == {None}


def test_segments_of_short_files(spark):
    f = spark.createDataFrame([(1, "b", 10), (2, "a", 3)], "path bigint, class string, n_frames bigint")
    got = framing.segment_index(f, 4).orderBy("start").collect()
    assert [(r.path, r.label, r.start) for r in got] == [(1, 1, 0), (1, 1, 2), (1, 1, 4), (1, 1, 6)]


def test_si_sdr_ignores_scale_and_length(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal(8), rng.standard_normal(8)
    e = a + 0.3 * b
    rows = [(0, a.tolist(), [*e.tolist(), 9.0, 9.0], [*b.tolist(), 1.0]), (1, a.tolist(), (2 * e).tolist(), b.tolist())]
    got = separation.measures(spark.createDataFrame(rows, "clip_id int, ref array<double>, est array<double>, other array<double>"), 8).orderBy("clip_id").collect()
    assert abs(got[0].si_sdr - got[1].si_sdr) < 1e-6 and got[0].duration_s == 1.0
    ac, ec = a - a.mean(), e - e.mean()
    target = (ec @ ac) / (ac @ ac) * ac
    assert abs(got[0].si_sdr - 10 * np.log10((target @ target) / ((ec - target) @ (ec - target)))) < 1e-6


def test_masks_sum_to_one(spark):
    from ultraframe.plans.queries import _parts

    parts = _parts(spark, SF).where("clip_id < 3")
    for mask in (separation.soft_mask(parts), separation.hard_mask(parts)):
        worst = mask.groupBy("clip_id", "f", "t").agg(F.abs(F.sum("m") - 1).alias("x")).agg(F.max("x")).first()[0]
        assert worst < 1e-6


def test_factorization_lowers_the_error():
    v = np.random.default_rng(4).random((9, 13)) + 0.01
    few, many = separation.factorize(v, 3, steps=1)[2], separation.factorize(v, 3, steps=100)[2]
    assert many < few
    w, h, _ = separation.factorize(v, 3, rule=Normalized())
    assert (w >= 0).all() and (h >= 0).all() and np.allclose(np.linalg.norm(w, axis=0), 1)


@pytest.mark.parametrize("beta", [0.0, 1.0, 2.0])
def test_updates_lower_each_loss(beta):
    v = np.random.default_rng(6).random((9, 13)) + 0.01

    def loss(steps):
        w, h, _ = separation.factorize(v, 3, beta, steps, 0.0)
        x = np.maximum(w @ h, separation.EPS)
        return (v / x - np.log(v / x) - 1 if beta == 0 else v * np.log(v / x) - v + x if beta == 1 else (v - x) ** 2 / 2).sum()

    falls = [loss(n) for n in (1, 5, 25, 100)]
    assert falls == sorted(falls, reverse=True)


def test_as_many_clusters_as_components_pass_through(spark):
    rows = spark.createDataFrame([(g, k, i, float(k * i + g)) for g in range(2) for k in range(3) for i in range(4)], "group bigint, k int, i int, x double")
    for found in (cluster.cluster_ward(rows, 3), cluster.cluster_spectral(cluster.cosine_affinity(rows, ("group",)), 5)):
        assert sorted((r.group, r.k, r.cluster) for r in found.collect()) == [(g, k, k) for g in range(2) for k in range(3)]


def test_clusterings_find_two_blobs():
    x = np.array([[0, 0], [0.1, 0], [0, 0.1], [5, 5], [5.1, 5], [5, 5.1]])
    near = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    for labels in (cluster.ward(x, 2), cluster.spectral(near, 2)):
        assert len(set(labels[:3])) == 1 and len(set(labels[3:])) == 1 and labels[0] != labels[3]


def test_upsample_cuts_and_pads(spark):
    f = spark.createDataFrame([(1, t, float(t)) for t in range(3)], "clip_id bigint, t int, x double")
    assert [r.x for r in pooling.upsample(f, 2, 8).orderBy("t").collect()] == [0, 0, 1, 1, 2, 2, 2, 2]
    assert pooling.upsample(f, 2, 3).count() == 3


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(100) / 5) * 0.5
    encoded = audio.encode(clip(spark, x).withColumn("name", F.lit("tone/a.wav")), 8000)
    audio.write(encoded, str(tmp_path))
    (tmp_path / "tone" / "bad.wav").write_bytes(b"no wave")
    found = audio.scan(spark, f"file:{tmp_path}")
    heads = audio.headers(found)
    assert heads.count() == 2 and audio.readable(heads).first()["n_frames"] == 100
    got = audio.decode(found).first()
    assert got["class"] == "tone" and np.allclose(got["samples"], x, atol=1e-4)
    assert len(audio.decode(found, 0.0, 0.005).first()["samples"]) == 40 and len(audio.decode(found, end_s=0.005).first()["samples"]) == 100
    assert np.allclose(audio.decode(found, samples=(10, 20)).first()["samples"], x[10:20], atol=1e-4)
    assert audio.recordings(spark, f"{tmp_path}/none").count() == 0 and audio.recordings(spark, f"{tmp_path}/tone/a.wav").count() == 1
    assert audio.listed(spark, [str(tmp_path), f"{tmp_path}/tone"]).count() == 2 and audio.evaluated(spark, str(tmp_path)).count() == 2


def test_damaged_header_falls_back(spark, tmp_path):
    x = np.sin(np.arange(50) / 5) * 0.5
    whole = audio.encode(clip(spark, x), 8000).first()["content"]
    (tmp_path / "a.wav").write_bytes(whole[:20] + b"\xff\xff" + whole[22:])
    found = audio.scan(spark, str(tmp_path))
    assert audio.decode(found).count() == 0 and np.allclose(audio.decode(found, fallback=True).first()["samples"], x, atol=1e-4)


def test_files_become_spectra_at_one_rate(spark, tmp_path):
    tone = np.sin(2 * np.pi * 500 * np.arange(800) / 8000) * 0.5
    audio.write(audio.encode(clip(spark, tone).withColumn("name", F.lit("a/x.wav")), 8000), str(tmp_path))
    got = audio.spectrum_of(audio.scan(spark, str(tmp_path)), 4000, 64, 16).where("t = 10").first()
    assert int(np.argmax(got["mag"])) == 8  # 500 Hz of 62.5 Hz bins
    assert got["sample_rate"] == 4000 and got["n_samples"] == 400
    assert np.allclose(np.array(got["mag"]) * (np.array(got["cos"]) + 1j * np.array(got["sin"])), np.array(got["re"]) + 1j * np.array(got["im"]))


def test_metrics_are_written(spark, tmp_path):
    preds = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "label string, pred string")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "class string")
    paths = audio.write_metrics(preds, labels, str(tmp_path), "segment_level")
    text = ["\n".join(p.read_text() for p in sorted(tmp_path.joinpath(x).glob("part-*"))) for x in paths]
    assert text[0].splitlines()[:3] == ["\ufefflabel,a,b,c", "a,1,1,0", "b,0,2,0"] and text[1].splitlines()[1] == "a,0.5,0.5,0.0"
    assert "macro avg" in text[2] and f"{'weighted avg':<20}" in text[3] and '"accuracy":0.75' in text[4]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, None), ("b,c", 2.0, "x")], "name string, v double, note string")
    read = lambda folder: "\n".join(p.read_text() for p in sorted(tmp_path.joinpath(folder).glob("part-*")))
    audio.write_report(rows, str(tmp_path / "r"))
    assert read("r").startswith("\ufeffname,v,note\n") and '"b,c",2.0,x' in read("r")
    audio.write_report(rows, str(tmp_path / "j"), "json")
    assert '{"name":"a","v":1.5}' in read("j")
    audio.write_report(rows, str(tmp_path / "t"), "text")
    assert f"{'a':<20}{'1.5':<20}" in read("t")
    (tmp_path / "file").write_text("")
    assert audio.write_report(rows, str(tmp_path / "file" / "r"), other=str(tmp_path / "second")) == str(tmp_path / "second")


def test_models_are_saved_and_loaded(spark, tmp_path):
    from ultraframe.operators import learn

    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, i % 2, (rng.standard_normal(4) + 3 * (i % 2)).tolist(), True) for i in range(60)], "clip_id bigint, class int, samples array<double>, is_train boolean")
    for name in learn.REGISTRY:
        model = learn.train(rows, name, width=4, classes=2)
        learn.save(model, str(tmp_path / name))
        again = learn.predict(learn.load(name, str(tmp_path / name)), rows)
        assert again.where(learn.predicted(F.col("scores")) == F.col("class")).count() > 55


def test_separated_sources_add_up(spark):
    from ultraframe.plans.queries import _cells, _parts

    cells, parts = _cells(spark, SF).where("clip_id < 2"), _parts(spark, SF).where("clip_id < 2")
    back = separation.separated(cells, separation.soft_mask(parts), tables.N_FFT, tables.HOP).groupBy("clip_id", "n").agg(F.sum("x").alias("x"))
    x = {r.clip_id: r.samples for r in tables.clips(spark, SF).where("clip_id < 2").collect()}
    assert all(abs(r.x - x[r.clip_id][r.n]) < 1e-6 for r in back.where("x is not null").collect())


@pytest.mark.parametrize("bad", [(0, 16, 4, 0, None), (64, 15, 4, 0, None), (64, 16, 0, 0, None), (64, 16, 4, 40, None), (64, 16, 4, 0, 33)])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        spectral.check_config(*bad)
    spectral.check_config(64, 16, 4)


def test_decibels_are_made_of_frames_before_cells(spark):
    """The window of a clip's loudest cell orders frames; its cells equal those of decibels(cells)."""
    from ultraframe.plans.queries import _cells, _db

    db = _db(spark, SF)
    plan = db._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("Window")  # from the top: cells come out of the window
    columns = ["clip_id", "class", "t", "k", "freq", "time_s", "mag", "mag_db"]
    some = "clip_id < 20"
    assert set(db.where(some).select(columns).collect()) == set(spectral.decibels(_cells(spark, SF)).where(some).select(columns).collect())
