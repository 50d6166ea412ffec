"""Queries of separation end to end, component features, and the heads and layers of classifiers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import mono, relu, relu6
from ..operators import activity, cluster, evaluate, framing, learn, pooling, separation, spectral
from ..sources import tables as T
from . import oracles as O
from .queries import AUDIBLE, KEEP, MELS, _activations, _cells, _db, _factors, _floors, _frame_energy, _frames, _parts, _spectra, r


def separated_sources(spark: SparkSession, sf: str) -> DataFrame:
    mask = separation.soft_mask(_parts(spark, sf))
    return separation.separated(_cells(spark, sf), mask, T.N_FFT, T.HOP).select("clip_id", "k", "n", r("x"))


def resynthesis(spark: SparkSession, sf: str) -> DataFrame:
    _, w, h = _factors(spark, sf)
    # Cells of next to no magnitude have no phase to speak of.
    cells = _cells(spark, sf).withColumns({c: F.when(F.col("mag") > 1e-6, F.col(c)).otherwise(0.0) for c in ("re", "im")})
    return separation.resynthesized(cells, w, h, T.N_FFT, T.HOP).select("clip_id", "n", r("x"))


def factor_change(spark: SparkSession, sf: str) -> DataFrame:
    v, w, h = _factors(spark, sf)
    return separation.change(w, separation.kl_step(v, w, h)[0], ["clip_id", "f", "k"], "w").select("clip_id", r("change"))


def separation_conditions(spark: SparkSession, sf: str) -> DataFrame:
    whole = T.triples(spark, sf)
    half = whole.withColumns({c: F.slice(c, 1, 32) for c in ("ref", "est")})
    both = separation.condition(separation.measures(whole, T.RATE), "whole", T.RATE).unionByName(separation.condition(separation.measures(half, T.RATE), "half", T.RATE))
    return both.select("condition", "sample_rate", "clip_id", r("sdr", 5), r("si_sdr", 5), r("sir", 5), "duration_s")


def component_features(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.features(_spectra(spark, sf), _activations(spark, sf), T.RATE, T.N_FFT, MELS, KEEP)
    return found.select("k", "name", r("x", 5))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return T.clips(spark, sf).select(F.col("class").alias("k")).distinct().withColumn("cluster", F.col("k") % 3)


def cluster_spectra(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_sums(_spectra(spark, sf), _labels(spark, sf)).select("cluster", "i", r("x"))


def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.members(_activations(spark, sf), _labels(spark, sf))
    return found.select("cluster", F.concat_ws(",", F.transform("components", lambda k: k.cast("string"))).alias("components"), "n", r("energy"))


def decision_max(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.decision_level(_frame_energy(spark, sf), "max", 4, 60, 0.5, -1.0)[0].select("clip_id", r("score"))


def decision_avg(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.decision_level(_frame_energy(spark, sf), "avg", 4, 60, 0.5, -1.0)[0].select("clip_id", r("score"))


def decision_frames(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.decision_level(_frame_energy(spark, sf), "max", 4, 60, 0.5, -1.0)[1].select("clip_id", "t", r("x"))


def batch_norm(spark: SparkSession, sf: str) -> DataFrame:
    mels = spectral.log_mel(_cells(spark, sf), T.RATE, T.N_FFT, MELS)
    stats = mels.groupBy("mel").agg(F.avg("log_mel").alias("mean"), F.var_pop("log_mel").alias("var"))
    stats = stats.select("mel", "mean", "var", (F.col("mel") + 1.0).alias("gain"), F.col("mel").cast("double").alias("shift"))
    return pooling.batch_norm(mels, stats, "mel", "log_mel").select("clip_id", "t", "mel", r("log_mel", 5))


def spectrum_stripes(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.stripes(_cells(spark, sf), "mag", ("t", 13, 3), ("k", 9, 2)).select("clip_id", "t", "k", r("mag"))


def overlay(spark: SparkSession, sf: str) -> DataFrame:
    db = _db(spark, sf)
    floors = _floors(db)
    return activity.overlay(db, floors, _frames(spark, sf), AUDIBLE).select("clip_id", "t", "k", (F.col("mag_db") + 0.0).alias("mag_db"), "mask")


def window_lengths(spark: SparkSession, sf: str) -> DataFrame:
    n, hop = spectral.window_of(F.col("n_frames"), 25.0)
    return T.files(spark, sf).select("path", n.alias("window"), hop.alias("hop"), framing.resampled_length(F.col("n_frames"), 44100, 32000).alias("resampled"))


def batch_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.predictions(spark, sf).select(F.expr("start div 32").alias("batch"), F.when(F.col("pred") == F.col("label"), 0.1).otherwise(2.3).alias("loss"))
    return evaluate.mean_batch_loss(rows).select(r("loss"), "n")


def batch_logits(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.clips(spark, sf).withColumn("batch", F.expr("clip_id div 32"))
    shares = F.transform("samples", lambda x: F.least(F.abs(x), F.lit(1.0)))
    rows = rows.withColumn("scores", F.when(F.col("batch") % 2 == 0, shares).otherwise(F.col("samples")))
    return learn.scores_as_logits(rows, "batch").select("clip_id", F.posexplode("scores").alias("n", "x")).select("clip_id", "n", r("x"))


def unit_phases(spark: SparkSession, sf: str) -> DataFrame:
    c, s = spectral.unit_phase(F.col("re"), F.col("im"))
    return _cells(spark, sf).where("mag > 1e-6").select("clip_id", "t", "k", r(c, name="c"), r(s, name="s"))


def channel_mean(spark: SparkSession, sf: str) -> DataFrame:
    # Two channels: the samples, and the samples backwards.
    pairs = F.zip_with("samples", F.reverse("samples"), lambda a, b: F.array(a, b))
    mixed = T.clips(spark, sf).select("clip_id", F.posexplode(mono(pairs)).alias("n", "x"))
    return mixed.select("clip_id", "n", r("x"), r(relu(F.col("x")), name="relu"), r(relu6(F.col("x") * 20), name="relu6"))


def epoch_order(spark: SparkSession, sf: str) -> DataFrame:
    return framing.shuffled(T.clips(spark, sf).select("clip_id", "class"), "clip_id", "class", 3)


def sorted_votes(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.majority_vote(T.predictions(spark, sf)).orderBy("file_id")


QUERIES = {
    f.__name__: f
    for f in (
        separated_sources, resynthesis, factor_change, separation_conditions, component_features, cluster_spectra, cluster_members, decision_max, decision_avg,
        decision_frames, batch_norm, spectrum_stripes, overlay, window_lengths, batch_loss, batch_logits, unit_phases, channel_mean, epoch_order, sorted_votes,
    )
}

COMPLEX = """
cx as (select clip_id, t::int as t, k::int as f, sum(x * c) as re, sum(x * b.s) as im
       from s join range(13) as f(t) on n >= 4 * t and n < 4 * t + 16 join b on j = n - 4 * t group by all)"""


def _back(spectrum: str, keys: str) -> str:
    """SQL of the inverse transform of spectrum (keys, t, f, re, im)."""
    return f"""
y as (select {keys}, t, j, (0.5 - 0.5 * cos(2 * pi() * j / 16)) / 16 * sum((case when f in (0, 8) then 1 else 2 end) * (re * cos(2 * pi() * f * j / 16) - im * sin(2 * pi() * f * j / 16))) as y
      from {spectrum}, range(16) as q(j) group by {keys}, t, j),
z as (select {keys}, (4 * t + j)::int as n, sum(y) as y, sum(pow(0.5 - 0.5 * cos(2 * pi() * j / 16), 2)) as w from y group by {keys}, 4 * t + j)
select {keys}, n, case when w > 1e-10 then round(y / w, 6) + 0.0 end as x from z"""


POOLED = f"""{O.ENERGY},
po as (select clip_id, t, max(x) over o + sum(x) over o / 3 as x, max(t) over (partition by clip_id) as e from fe window o as (partition by clip_id order by t rows between 1 preceding and 1 following)),
sg as (select clip_id, t, e, 1 / (1 + exp(-(x * 0.5 - 1))) as x from po)"""
LABELS = "la as (select distinct class as k, class % 3 as cluster from s)"


def _hit(place: str, size: int, width: int, seed: int) -> str:
    start = f"((clip_id * 1103515245 + {seed} * 12345) % 2147483648 % {size - width + 1})"
    return f"({place} >= {start} and {place} < {start} + {width})"


SQL = {
    "separated_sources": f"with {O.SOFT}, {COMPLEX}, ma as (select clip_id, so.k, t, f, re * m as re, im * m as im from so join cx using (clip_id, t, f)), {_back('ma', 'clip_id, k')}",
    "resynthesis": f"""with {O.FACTORS}, {COMPLEX}, vh as (select clip_id, f, t, sum(v) as v from pt group by all),
        ma as (select clip_id, t, f, v * (case when m > 1e-6 then re / m else 1 end) as re, v * (case when m > 1e-6 then im / m else 0 end) as im from (select *, sqrt(re * re + im * im) as m from cx) join vh using (clip_id, t, f)), {_back('ma', 'clip_id')}""",
    "factor_change": f"""with {O.STEP} select clip_id, round(sqrt(sum(pow(w1.w - w0.w, 2))) / sqrt(sum(w0.w * w0.w)), 6) as change from w0 join w1 using (clip_id, f, k) group by 1""",
    "separation_conditions": f"""with {O.CLIPS}, t as (select a.clip_id, a.n, a.x as r, b.x as o, a.x + 0.1 * b.x as e from s a join s b on b.clip_id = a.clip_id + 1 and a.n = b.n),
        c as (select *, 'whole' as condition from t union all select *, 'half' from t where n < 32),
        z as (select *, r - avg(r) over w as rz, e - avg(e) over w as ez, o - avg(o) over w as oz from c window w as (partition by condition, clip_id)),
        a as (select condition, clip_id, count(*) as n, sum(r * r) as rr, sum((r - e) * (r - e)) as nn, sum(rz * rz) as rzz, sum(oz * oz) as ozz, sum(ez * rz) / (sum(rz * rz) + 1e-12) as al, sum(ez * oz) / (sum(oz * oz) + 1e-12) as be from z group by all),
        d as (select condition, clip_id, sum(pow(ez - al * rz, 2)) as nz from z join a using (condition, clip_id) group by all)
        select condition, 64 as sample_rate, clip_id, round(10 * log10((rr + 1e-12) / (nn + 1e-12)), 5) as sdr, round(10 * log10((al * al * rzz + 1e-12) / (nz + 1e-12)), 5) as si_sdr,
               round(10 * log10((al * al * rzz + 1e-12) / (be * be * ozz + 1e-12)), 5) as sir, n / 64.0::double as duration_s from a join d using (condition, clip_id)""",
    "component_features": f"""with {O.SPECTRA}, {O.ACTIVE}, {O.CORR}, {O.MEL},
        mf as (select sp.k, mel, 10 * log10(greatest(sum(x * x * weight), 1e-10)) as v from sp join ml on ml.k = sp.i where weight > 0 group by all),
        cu as (select *, sum(x) over (partition by k order by i) as cum, sum(x) over (partition by k) as total from sp),
        fs as (select k, 'mfcc_' || c as name, sum(v * (case when c = 0 then sqrt(0.25) else sqrt(0.5) end) * cos(pi() * c * (2 * mel + 1) / 8)) as x from mf, range(3) as u(c) group by k, c
               union all select k, 'centroid', sum(i * 4.0 * x) / sum(x) from sp group by k
               union all select k, 'rolloff', min(i * 4.0::double) from cu where round(cum, 9) >= round(0.85 * total, 9) group by k
               union all select k, 'flatness', exp(avg(ln(greatest(x * x, 1e-10)))) / avg(greatest(x * x, 1e-10)) from sp group by k
               union all select k, 'skew', (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / pow(var_pop(x), 1.5) from ac group by k
               union all select a, 'corr_' || b, 2 * weight - 1 from cr union all select b, 'corr_' || a, 2 * weight - 1 from cr where a < b)
        select k, name, round(case when stddev_pop(x) over w > 1e-12 then (x - avg(x) over w) / stddev_pop(x) over w else 0 end, 5) + 0.0 as x from fs window w as (partition by name)""",
    "cluster_spectra": f"with {O.SPECTRA}, {LABELS} select cluster, i, round(sum(x), 6) as x from sp join la using (k) group by all",
    "cluster_members": f"with {O.CELLS}, {O.ACTIVE}, {LABELS}, en as (select k, sum(x * x) as e from ac group by 1) select cluster, string_agg(k::varchar, ',' order by k) as components, count(*) as n, round(sum(e), 6) as energy from en join la using (k) group by 1",
    "decision_max": f"with {POOLED} select clip_id, round(max(x), 6) as score from sg where t < e group by 1",
    "decision_avg": f"with {POOLED} select clip_id, round(avg(x), 6) as score from sg group by 1",
    "decision_frames": f"with {POOLED} select clip_id, i::int as t, round(x, 6) as x from range(60) as q(i) join sg on t = least(i // 4, e - 1)",
    "batch_norm": f"with {O.CELLS}, {O.MEL} select clip_id, t, mel::int as mel, round((v - avg(v) over w) / sqrt(var_pop(v) over w + 1e-5) * (mel + 1) + mel, 5) + 0.0 as log_mel from lm window w as (partition by mel)",
    "spectrum_stripes": f"with {O.CELLS} select clip_id, t, k, case when {' or '.join([_hit('t', 13, 3, 7), _hit('t', 13, 3, 8), _hit('k', 9, 2, 9), _hit('k', 9, 2, 10)])} then 0.0 else round(mag, 6) end::double as mag from cells",
    "overlay": f"with {O.FRAMES} select clip_id, t, k, mag_db + 0.0 as mag_db, coalesce(playing and freq > 20 and mag_db > ut, false) as mask from db join th using (clip_id) join fr using (clip_id, t)",
    "window_lengths": "select doc_id as path, trunc(n_chars * 25.0::double / 1000)::bigint as window, (trunc(n_chars * 25.0::double / 1000)::bigint // 4)::bigint as hop, trunc(n_chars / 44100::double * 32000)::bigint as resampled from documents",
    "batch_loss": f"with {O.PREDS}, l as (select start // 32 as b, avg(case when pred = label then 0.1::double else 2.3 end) as l from pr group by 1) select round(avg(l), 6) as loss, count(*) as n from l",
    "batch_logits": f"""with {O.CLIPS}, p as (select clip_id, n, case when (clip_id // 32) % 2 = 0 then least(abs(x), 1) else x end as x from s),
        q as (select *, min(x) over w as low, max(x) over w as high from p window w as (partition by clip_id // 32)),
        k as (select *, greatest(least(x, 1 - 1e-6::double), 1e-6::double) as c from q)
        select clip_id, n::int as n, round(case when low >= 0 and high <= 1 then ln(c / (1 - c)) else x end, 6) + 0.0 as x from k""",
    "unit_phases": f"with {O.CELLS}, {COMPLEX} select clip_id, t, f as k, round(re / sqrt(re * re + im * im), 6) + 0.0 as c, round(im / sqrt(re * re + im * im), 6) + 0.0 as s from cx where sqrt(re * re + im * im) > 1e-6",
    "channel_mean": "with m as (select vec_id as clip_id, (i - 1)::int as n, (embedding[i]::double + list_reverse(embedding)[i]::double) / 2 as x from embeddings, range(1, 65) as r(i)) select clip_id, n, round(x, 6) + 0.0 as x, round(greatest(x, 0), 6) + 0.0 as relu, round(least(greatest(x * 20, 0), 6), 6) + 0.0 as relu6 from m",
    "epoch_order": "select vec_id as clip_id, label as class, row_number() over (partition by label order by md5('3|' || vec_id), vec_id)::int as place from embeddings",
    "sorted_votes": O.SQL["majority_vote"],
}
