"""Queries of fitted factors and of sources separated by them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, factors, spectral
from ..sources import tables as T
from . import model as M
from . import oracles as O
from .queries import KEEP, MELS, r
from .separate import separate

#: Components, sources, steps, and frames of a chunk: clips have 13 frames here, so four chunks each.
K, SOURCES, STEPS, LENGTH = 3, 2, 3, 4


def spectra(f, k):
    """Where spectra start from."""
    return (1 + (f * 3 + k * 5) % 7) / 7.0


def gains(t, k):
    """Where activations start from."""
    return (1 + (t * 2 + k * 3) % 5) / 5.0


def _fitted(spark: SparkSession, sf: str, rule: factors.Rule, steps: int) -> DataFrame:
    """clip_id, factor, at (a bin or a frame), k, x: both factors as one table."""
    frames = spectral.magnitude(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP))
    w, h, _ = factors.factorize(frames, K, spectra, gains, rule, steps, 0.0, length=LENGTH)
    return w.select("clip_id", F.lit("w").alias("factor"), F.col("f").alias("at"), "k", r("w", name="x")).union(h.select("clip_id", F.lit("h"), "t", "k", r("h", name="x")))


def fitted_factors(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, factors.Normalized(), STEPS)


def fitted_by_descent(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, factors.CoordinateDescent(), 1)


def separation_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    found = separate(T.clips(spark, sf), T.RATE, T.N_FFT, T.HOP, K, SOURCES, spectra, gains, steps=STEPS, tolerance=0.0, method="agglomerative", mels=MELS, keep=KEEP, length=LENGTH)
    return found.select("clip_id", "k", "n", r("x", 5))


def component_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted components of each clip, clustered by all their features."""
    frames = spectral.magnitude(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP))
    w, h, _ = factors.factorize(frames, K, spectra, gains, steps=STEPS, tolerance=0.0, length=LENGTH)
    by_bin, by_frame = w.select("clip_id", "k", F.col("f").alias("i"), F.col("w").alias("x")), h.select("clip_id", "k", F.col("t").alias("i"), F.col("h").alias("x"))
    return cluster.labelled(by_bin, by_frame, SOURCES, "agglomerative", T.RATE, T.N_FFT, MELS, KEEP).select("clip_id", "k", "cluster")


QUERIES = {f.__name__: f for f in (fitted_factors, fitted_by_descent, component_clusters, separation_end_to_end)}


def _swept(name: str, value: str, source: str, place: str, other: str, across: str, of: str) -> str:
    """CTE of one sweep over three components: value of source by place, with the sums of other over across."""
    x = ", ".join(f"max({value}) filter (k = {c}) as x{c}" for c in range(3))
    g = ", ".join(f"sum(a.{of} * b.{of}) filter (a.k = {c} and b.k = {d}) as g{c}{d}" for c in range(3) for d in range(3))
    y = ", ".join(f"sum(v.v * o.{of}) filter (o.k = {c}) as y{c}" for c in range(3))
    steps, now = [], ["x0", "x1", "x2"]
    for c in range(3):
        steps.append(f"case when g{c}{c} > 0 then greatest(x{c} - ({' + '.join(f'{now[d]} * g{d}{c}' for d in range(3))} - y{c}) / g{c}{c}, 0) else x{c} end as z{c}")
        now[c] = f"z{c}"
    return f"""{name} as materialized (select *, {", ".join(steps)} from
        (select clip_id, {place}, {x} from {source} group by all) join
        (select a.clip_id, {g} from {other} a join {other} b on a.clip_id = b.clip_id and a.{across} = b.{across} group by all) using (clip_id) join
        (select v.clip_id, v.{place}, {y} from v join {other} o on v.clip_id = o.clip_id and v.{across} = o.{across} group by all) using (clip_id, {place}))"""


def _long(name: str, wide: str, place: str, value: str) -> str:
    return f"{name} as materialized (" + " union all ".join(f"select clip_id, {place}, {c} as k, z{c} as {value} from {wide}" for c in range(3)) + ")"


BOTH = "select clip_id, 'w' as factor, f as at, k, round(w, 6) + 0.0 as x from {w} union all select clip_id, 'h', t, k, round(h, 6) + 0.0 from {h}"
FEATURES = f"""{O.MEL.split("lm as")[0].rstrip().rstrip(",")},
    sp as (select clip_id, k, f as i, greatest(w, 1e-10) as x from w{STEPS}),
    mf as (select clip_id, sp.k, mel, 10 * log10(greatest(sum(x * x * weight), 1e-10)) as v from sp join ml on ml.k = sp.i where weight > 0 group by all),
    cu as (select *, sum(x) over (partition by clip_id, k order by i) as cum, sum(x) over (partition by clip_id, k) as total from sp),
    ah as (select *, h - avg(h) over (partition by clip_id, k) as c from h{STEPS}),
    co as (select a.clip_id, a.k as a, b.k as b, coalesce(sum(a.c * b.c) / nullif(sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 0), 0) as r from ah a join ah b on a.clip_id = b.clip_id and a.t = b.t group by all),
    fs as (select clip_id, k, 'mfcc_' || c as name, sum(v * (case when c = 0 then sqrt(0.25) else sqrt(0.5) end) * cos(pi() * c * (2 * mel + 1) / 8)) as x from mf, range({KEEP}) as u(c) group by all
           union all select clip_id, k, 'centroid', sum(i * 4.0 * x) / sum(x) from sp group by all
           union all select clip_id, k, 'rolloff', min(i * 4.0::double) from cu where round(cum, 9) >= round(0.85 * total, 9) group by all
           union all select clip_id, k, 'flatness', exp(avg(ln(greatest(x * x, 1e-10)))) / avg(greatest(x * x, 1e-10)) from sp group by all
           union all select clip_id, k, 'skew', avg(c * c * c) / nullif(pow(avg(c * c), 1.5), 0) from ah group by all
           union all select clip_id, a, 'corr_' || b, r from co),
    fx as (select clip_id, k, name, coalesce(case when stddev_pop(x) over w > 1e-12 then (x - avg(x) over w) / stddev_pop(x) over w end, 0) as x from fs window w as (partition by clip_id, name)),
    dd as (select a.clip_id, a.k as a, b.k as b, round(sum(pow(a.x - b.x, 2)) / 2, 9) as cost from fx a join fx b on a.clip_id = b.clip_id and a.name = b.name and a.k < b.k group by all),
    me as (select clip_id, first(a order by cost, a, b) as a, first(b order by cost, a, b) as b from dd group by 1),
    la as (select clip_id, k, case when a = 0 and b = 1 then k // 2 when b = 2 and a = 0 then k % 2 else least(k, 1) end as s from me, range(3) as q(k)),
    ws as (select clip_id, s as k, f, sum(w) as w from w{STEPS} join la using (clip_id, k) group by all),
    hs as (select clip_id, s as k, t, sum(h) as h from h{STEPS} join la using (clip_id, k) group by all),
    pp as (select clip_id, k, f, t, pow(w * h, 2) as p from ws join hs using (clip_id, k)),
    sm as (select clip_id, k, f, t, p / (sum(p) over (partition by clip_id, f, t) + 1e-10) as m from pp),
    md as (select clip_id, k, f, t, least(greatest(list_sort([{", ".join(f"coalesce({'lag' if i > 0 else 'lead'}(m, {abs(i)}) over o, 0)" for i in range(-2, 3))}])[3], 0), 1) as m from sm window o as (partition by clip_id, k, f order by t)),
    ma as (select clip_id, k, t, f, re * m / (1 + exp(-(m - 0.1) / (0.05 + 1e-8))) as re, im * m / (1 + exp(-(m - 0.1) / (0.05 + 1e-8))) as im from md join cx using (clip_id, t, f)),"""

SQL = {
    "fitted_factors": f"with {O.FACTORS}, {O.kl_steps(STEPS)} {BOTH.format(w=f'w{STEPS}', h=f'h{STEPS}')}",
    "fitted_by_descent": f"with {O.FACTORS}, {_swept('wx', 'w', 'w', 'f', 'h', 't', 'h')}, {_long('w1', 'wx', 'f', 'w')}, {_swept('hx', 'h', 'h', 't', 'w1', 'f', 'w')}, {_long('h1', 'hx', 't', 'h')} {BOTH.format(w='w1', h='h1')}",
    "component_clusters": f"with {O.FACTORS}, {O.kl_steps(STEPS)}, {M.COMPLEX}, {FEATURES} select clip_id, k::int as k, s::int as cluster from la".replace("join cx using (clip_id, t, f)), select", "join cx using (clip_id, t, f)) select"),
    "separation_end_to_end": f"with {O.FACTORS}, {O.kl_steps(STEPS)}, {M.COMPLEX}, {FEATURES} {M._back('ma', 'clip_id, k')}".replace("round(y / w, 6)", "round(y / w, 5)"),
}
