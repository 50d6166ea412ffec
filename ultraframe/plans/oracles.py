"""DuckDB SQL for the rows of the queries, written from the definitions."""

CLIPS = """
s as (select vec_id as clip_id, label as class, n - 1 as n, embedding[n]::double as x from embeddings, range(1, 65) as r(n))"""
CELLS = f"""{CLIPS},
b as (select j, k, (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * j * k / 16) as c, -(0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * j * k / 16) as s
      from range(16) as t(j), range(9) as u(k)),
cells as (select clip_id, class, t::int as t, k::int as k, k * 4.0::double as freq, (t * 4 + 8) / 64.0::double as time_s,
                 sqrt(pow(sum(x * c), 2) + pow(sum(x * b.s), 2)) as mag
          from s join range(13) as f(t) on n >= 4 * t and n < 4 * t + 16 join b on j = n - 4 * t group by all)"""
DB = f"""{CELLS},
db as (select *, round(greatest(20 * log10(greatest(mag, 1e-5) / greatest(max(mag) over (partition by clip_id), 1e-5)), -120), 9) as mag_db from cells)"""
FLOORS = f"""{DB},
fl as (select clip_id, quantile_cont(mag_db, 0.1) as g, quantile_cont(mag_db, 0.1) filter (freq <= 20) as a, quantile_cont(mag_db, 0.1) filter (freq > 20) as u from db group by 1),
th as (select *, greatest(g + 20, -70) as gt, greatest(u + 20, -70) as ut from fl)"""
FRAMES = f"""{FLOORS},
fr as (select clip_id, t, time_s, max(mag_db) filter (freq <= 20) > -8 as playing, coalesce(bool_or(mag_db > ut) filter (freq > 20), false) as ultra,
              max(freq) filter (mag_db > gt) as top_freq from db join th using (clip_id) group by all)"""
WINDOWS = f"""{FRAMES},
en as (select clip_id, max(time_s) as e from fr group by 1),
wi as (select clip_id, floor(time_s / 0.25) as w, count(*) filter (playing and ultra) / nullif(count(*) filter (playing), 0) as share
       from fr join en using (clip_id) where floor(time_s / 0.25) < ceil(e / 0.25) group by all),
ps as (select clip_id, count(share) as n_windows, avg(share) as pua_sec from wi group by 1),
pf as (select clip_id, count(*) filter (playing) as np, count(*) filter (playing and ultra) as nu, count(*) filter (playing and ultra) / nullif(count(*) filter (playing), 0) as pua_frame from fr group by 1)"""
MEL = """
ml as (select mel, k, greatest(0, least((k * 4.0 - p0) / (p1 - p0), (p2 - k * 4.0) / (p2 - p1))) as weight from (
    select mel, k, 700 * (pow(10, (2595 * log10(1 + 32 / 700.0::double)) * mel / 5 / 2595) - 1) as p0, 700 * (pow(10, (2595 * log10(1 + 32 / 700.0::double)) * (mel + 1) / 5 / 2595) - 1) as p1,
           700 * (pow(10, (2595 * log10(1 + 32 / 700.0::double)) * (mel + 2) / 5 / 2595) - 1) as p2 from range(4) as m(mel), range(9) as u(k))),
lm as (select clip_id, t, mel, 10 * log10(greatest(sum(mag * mag * weight), 1e-10)) as v from cells join ml using (k) where weight > 0 group by all)"""
PREDS = f"""{CLIPS},
ce as (select class as pred, n, avg(x) as m from s group by all),
co as (select clip_id, class, pred, round(sum(x * m) / greatest(sqrt(sum(x * x)) * sqrt(sum(m * m)), 1e-12), 9) as c from s join ce using (n) group by all),
pr as (select (class * 100 + clip_id % 7)::bigint as file_id, clip_id as start, class as label, pred from co qualify row_number() over (partition by clip_id order by c desc, pred) = 1)"""
SCORES = f"""{PREDS},
cl as (select distinct class from s),
sc as (select class, count(*) filter (label = class and pred = class) as tp, count(*) filter (label = class) as nt, count(*) filter (pred = class) as np
       from cl join pr on label = class or pred = class group by 1),
pc as (select class, coalesce(tp / nullif(np, 0), 0) as p, coalesce(tp / nullif(nt, 0), 0) as r, coalesce(2 * tp / nullif(nt + np, 0), 0) as f, nt from sc)"""
FACTORS = f"""{CELLS},
w as (select clip_id, f::int as f, k::int as k, (1 + (f * 3 + k * 5) % 7) / 7.0::double as w from (select distinct clip_id from s), range(9) as a(f), range(3) as b(k)),
h as (select clip_id, k::int as k, t::int as t, (1 + (t * 2 + k * 3) % 5) / 5.0::double as h from (select distinct clip_id from s), range(13) as a(t), range(3) as b(k)),
v as (select clip_id, k as f, t, mag as v from cells),
pt as (select clip_id, k, f, t, w * h as v from w join h using (clip_id, k))"""


def kl_steps(n: int) -> str:
    """CTEs of n updates of w and h, h first; the last are w{n} and h{n}."""
    parts = ["w0 as (from w)", "h0 as (from h)"]
    for i in range(n):
        q = "select clip_id, f, t, v.v / greatest(sum(w * h), 1e-10) as q from w{i} join h{j} using (clip_id, k) join v using (clip_id, f, t) group by clip_id, f, t, v.v"
        parts += [
            f"qh{i} as materialized ({q.format(i=i, j=i)})",
            f"""hu{i} as materialized (select clip_id, k, t, greatest(any_value(h) * sum(q * w) / (any_value(d) + 1e-10), 1e-10) as h from qh{i} join w{i} using (clip_id, f) join h{i} using (clip_id, k, t)
                join (select clip_id, k, sum(w) as d from w{i} group by all) using (clip_id, k) group by clip_id, k, t)""",
            f"qw{i} as materialized ({q.format(i=i, j=f'u{i}')})",
            f"""wu{i} as materialized (select clip_id, f, k, greatest(any_value(w) * sum(q * h) / (any_value(d) + 1e-10), 1e-10) as w from qw{i} join hu{i} using (clip_id, t) join w{i} using (clip_id, f, k)
                join (select clip_id, k, sum(h) as d from hu{i} group by all) using (clip_id, k) group by clip_id, f, k)""",
            f"no{i} as materialized (select clip_id, k, sqrt(sum(w * w)) + 1e-10 as norm from wu{i} group by all)",
            f"w{i + 1} as materialized (select clip_id, f, k, w / norm as w from wu{i} join no{i} using (clip_id, k))",
            f"h{i + 1} as materialized (select clip_id, k, t, h * norm as h from hu{i} join no{i} using (clip_id, k))",
        ]
    return ",\n".join(parts)


STEP = f"{FACTORS}, {kl_steps(1)}"
SOFT = f"""{FACTORS},
so as (select clip_id, k, f, t, v * v / (sum(v * v) over (partition by clip_id, f, t) + 1e-10) as m from pt)"""


def _median(kernel: int) -> str:
    half = kernel // 2
    lags = ", ".join(f"coalesce(lag(m, {i}) over o, 0)" if i > 0 else f"coalesce(lead(m, {-i}) over o, 0)" for i in range(-half, half + 1))
    return f"select clip_id, k, f, t, least(greatest(list_sort([{lags}])[{half + 1}], 0), 1) as m from so window o as (partition by clip_id, k, f order by t)"


ENERGY = f"""{CELLS},
fe as (select clip_id, t, sum(mag) as x from cells group by all)"""
SPECTRA = f"{CELLS}, sp as (select class as k, k as i, avg(mag) as x from cells group by all)"
ACTIVE = "ac as (select class as k, t as i, avg(mag) as x from cells group by all)"
COSINE = "cs as (select a.k as a, b.k as b, (coalesce(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)), 0), 0) + 1) / 2 as weight from sp a join sp b on a.i = b.i and a.k <= b.k group by all)"
CORR = "cr as (select a.k as a, b.k as b, (coalesce(sum((a.x - ma) * (b.x - mb)) / nullif(sqrt(sum((a.x - ma) * (a.x - ma)) * sum((b.x - mb) * (b.x - mb))), 0), 0) + 1) / 2 as weight from (select *, avg(x) over (partition by k) as ma from ac) a join (select *, avg(x) over (partition by k) as mb from ac) b on a.i = b.i and a.k <= b.k group by all)"
SCENES = "case i % 3 when 0 then '96kHz' when 1 then '44kHz' else '44.1kHz' end"
SHARE = """select {start} as start, event_type, count(*) filter (value > 20) as n_play, {share} as share
from events group by time_bucket(interval 1 hour, ts), event_type"""

SQL = {
    "file_index": "select doc_id as path, lang as class, (dense_rank() over (order by lang) - 1)::int as label, n_chars as n_frames from documents",
    "label_map": "select lang as class, (row_number() over (order by lang) - 1)::int as label from (select distinct lang from documents)",
    "segment_index": "select doc_id as path, (select count(distinct lang) from documents e where e.lang < d.lang)::int as label, unnest(range(0, n_chars - 800 + 1, 400)) as start from documents d where n_chars >= 800",
    "clip_level": f"with {CLIPS} select clip_id, round(sqrt(avg(x * x)), 6) as rms, round(max(abs(x)), 6) as peak, round(sqrt(avg(x * x)) / (max(abs(x)) + 1e-6), 6) as rms_normalized from s group by 1",
    "pad_or_trim": f"with {CLIPS} select clip_id, 48 as n, round(sum(x * x), 6) as energy from s where n < 48 group by 1",
    "next_valid": f"""with {CLIPS}, l as (select clip_id, class, round(sqrt(avg(x * x)) / (max(abs(x)) + 1e-6), 9) >= 0.45 as ok from s group by all)
        select clip_id, class, coalesce((select min(m.clip_id) from l m where m.class = l.class and m.ok and m.clip_id >= l.clip_id), (select min(m.clip_id) from l m where m.class = l.class and m.ok)) as used from l""",
    "stft_magnitude": f"with {CELLS} select clip_id, t, k, freq, time_s, round(mag, 6) + 0.0 as mag from cells",
    "stft_relational": f"with {CELLS} select clip_id, t, k, round(mag, 6) + 0.0 as mag from cells",
    "spectrogram_db": f"with {DB} select clip_id, t, k, mag_db + 0.0 as mag_db from db",
    "noise_floors": f"with {FLOORS} select clip_id, round(g, 4) as noise_global_db, round(a, 4) as noise_audible_db, round(u, 4) as noise_ultra_db, round(gt, 4) as global_threshold_db, round(ut, 4) as ultra_threshold_db from th",
    "pua_frame": f"with {WINDOWS} select clip_id, np as n_play_frames, nu as n_ultra_frames, round(pua_frame, 6) as pua_frame from pf",
    "pua_sec": f"with {WINDOWS} select clip_id, n_windows, round(pua_sec, 6) as pua_sec from ps",
    "frequency_counts": f"with {FRAMES} select clip_id, k, freq, count(*) filter (playing and mag_db > gt) as n from db join th using (clip_id) join (select clip_id, t, playing from fr) using (clip_id, t) group by all",
    "top_frequency": f"with {FRAMES} select clip_id, t, time_s, top_freq from fr where playing",
    "top_frequency_histogram": f"with {FRAMES}, p as (select top_freq as v from fr where playing and top_freq is not null), e as (select min(v) as a, max(v) as z from p) select coalesce(least(floor((v - a) / nullif(z - a, 0) * 80), 79), 0)::int as bin, count(*) as n from p, e group by 1",
    "price_histogram": "with e as (select min(o_totalprice) as a, max(o_totalprice) as z from orders) select least(floor((o_totalprice - a) / (z - a) * 80), 79)::int as bin, count(*) as n from orders, e group by 1",
    "ultrasonic_summary": f"""with {WINDOWS}, tp as (select clip_id, max(top_freq) as m, max(top_freq) filter (top_freq > 20) as mu from fr where playing group by 1)
        select clip_id, round_even(pua_frame * 100, 0) / 100 as pua_frame, round_even(pua_sec * 100, 0) / 100 as pua_sec, coalesce(np, 0) as n_play_frames, coalesce(nu, 0) as n_ultra_frames,
               round_even(m, 0)::double as max_freq_overall_hz, round_even(mu, 0)::double as max_ultrasonic_freq_hz, round(g, 4) as noise_global_db, round(a, 4) as noise_audible_db, round(u, 4) as noise_ultra_db, 'ok' as status
        from th left join pf using (clip_id) left join ps using (clip_id) left join tp using (clip_id)""",
    "log_mel": f"with {CELLS}, {MEL} select clip_id, t, mel::int as mel, round(v, 6) + 0.0 as log_mel from lm",
    "mfcc": f"with {CELLS}, {MEL} select clip_id, t, c::int as c, round(sum(v * case when c = 0 then sqrt(0.25) else sqrt(0.5) end * cos(pi() * c * (2 * mel + 1) / 8)), 6) + 0.0 as mfcc from lm, range(3) as d(c) group by all",
    "spectral_shape": f"""with {CELLS}, m as (select clip_id, k, freq, avg(mag) as m from cells group by all), c as (select *, sum(m) over (partition by clip_id order by k) as cum, sum(m) over (partition by clip_id) as tot from m)
        select clip_id, round(sum(freq * m) / sum(m), 6) as centroid, min(freq) filter (round(cum, 9) >= round(0.85 * tot, 9)) as rolloff, round(exp(avg(ln(greatest(m * m, 1e-10)))) / avg(greatest(m * m, 1e-10)), 6) as flatness from c group by 1""",
    "activation_skew": f"with {ENERGY}, a as (select *, avg(x) over (partition by clip_id) as m from fe) select clip_id, round(avg(pow(x - m, 3)) / pow(var_pop(x), 1.5), 5) + 0.0 as skew from a group by 1",
    "predictions": f"with {PREDS} select * from pr",
    "logit_argmax": f"with {CLIPS}, l as (select clip_id, n, round(ln(p / (1 - p)), 9) as z from (select clip_id, n, greatest(least(abs(x) * 4, 1 - 1e-6), 1e-6) as p from s)) select clip_id, first(n order by z desc, n)::int as pred, round(max(z), 6) + 0.0 as top from l group by 1",
    "majority_vote": f"with {PREDS}, v as (select file_id, pred, count(*) as n, min(start) as f from pr group by all), b as (select file_id, first(pred order by n desc, f) as pred from v group by 1) select file_id, arg_max(label, start) as label, any_value(b.pred) as pred from pr join b using (file_id) group by 1",
    "accuracy": f"with {PREDS} select count(*) as n, round(avg((label = pred)::int), 6) as accuracy from pr",
    "macro_scores": f"with {SCORES} select round(avg(p), 6) as precision_macro, round(avg(r), 6) as recall_macro, round(avg(f), 6) as f1_macro from pc",
    "confusion": f"""with {SCORES}, g as (select a.class as label, b.class as pred from cl a, cl b), n as (select label, pred, count(*) as n from pr group by all),
        m as (select label, pred, coalesce(n, 0) as n from g left join n using (label, pred)) select label, pred, n, round(coalesce(n / nullif(sum(n) over (partition by label), 0), 0), 6) as share from m""",
    "class_report": f"""with {SCORES} select class::varchar as name, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, nt as support from pc
        union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(nt)::bigint from pc
        union all select 'weighted avg', round(sum(p * nt) / sum(nt), 6), round(sum(r * nt) / sum(nt), 6), round(sum(f * nt) / sum(nt), 6), sum(nt)::bigint from pc""",
    "exact_split": "select vec_id as clip_id, label as class, row_number() over (order by ('0x' || md5('42|' || vec_id)[1:13])::bigint, vec_id) > floor(0.2::double * count(*) over ()) as is_train from embeddings",
    "mixup": """with b as (select vec_id, vec_id // 32 as b, vec_id % 32 as p, count(*) over (partition by vec_id // 32) as n, embedding as e from embeddings)
        select x.vec_id as clip_id, (i - 1)::int as n, round(x.e[i]::double * 0.7 + y.e[i]::double * 0.3, 6) + 0.0 as x from b x join b y on x.b = y.b and y.p = x.n - 1 - x.p, range(1, 65) as q(i)""",
    "separation_measures": f"""with {CLIPS}, t as (select a.clip_id, a.n, a.x as r, b.x as o, a.x + 0.1 * b.x as e from s a join s b on b.clip_id = a.clip_id + 1 and a.n = b.n),
        z as (select *, r - avg(r) over c as rz, e - avg(e) over c as ez from t window c as (partition by clip_id)),
        oz as (select *, o - avg(o) over (partition by clip_id) as oz from z),
        a as (select clip_id, sum(r * r) as rr, sum((r - e) * (r - e)) as nn, sum(ez * rz) / (sum(rz * rz) + 1e-12) as al, sum(ez * oz) / (sum(oz * oz) + 1e-12) as be, sum(rz * rz) as rzz, sum(oz * oz) as ozz from oz group by 1),
        d as (select clip_id, sum(pow(ez - al * rz, 2)) as nz from oz join a using (clip_id) group by 1)
        select clip_id, round(10 * log10((rr + 1e-12) / (nn + 1e-12)), 5) as sdr, round(10 * log10((al * al * rzz + 1e-12) / (nz + 1e-12)), 5) as si_sdr, round(10 * log10((al * al * rzz + 1e-12) / (be * be * ozz + 1e-12)), 5) as sir, 1.0::double as duration_s from a join d using (clip_id)""",
    "spectral_affinity": f"with {SPECTRA}, {COSINE} select a, b, round(weight, 6) as weight from cs",
    "temporal_affinity": f"with {CELLS}, {ACTIVE}, {CORR} select a, b, round(weight, 6) as weight from cr",
    "blended_affinity": f"with {SPECTRA}, {ACTIVE}, {COSINE}, {CORR} select a, b, round(least(greatest(cs.weight * 0.7 + cr.weight * 0.3, 0), 1), 6) as weight from cs join cr using (a, b)",
    "nmf_step_w": f"with {STEP} select clip_id, f, k, round(w, 6) as w from w1",
    "nmf_step_h": f"with {STEP} select clip_id, k, t, round(h, 6) as h from h1",
    "soft_mask": f"with {SOFT} select clip_id, k, f, t, round(m, 6) as m from so",
    "hard_mask": f"with {FACTORS} select clip_id, k, f, t, (row_number() over (partition by clip_id, f, t order by round(v, 9) desc, k) = 1)::int::double as m from pt",
    "median_mask": f"with {SOFT} select clip_id, k, f, t, round(m, 6) as m from ({_median(5)})",
    "refined_mask": f"with {SOFT} select clip_id, k, f, t, round(m / (1 + exp(-(m - 0.2) / (0.05 + 1e-8))), 6) as m from ({_median(3)})",
    "istft_round_trip": f"with {CLIPS} select clip_id, n::int as n, case when n > 0 then round(x, 6) + 0.0 end as x from s",
    "pool_max_avg3": f"with {ENERGY} select clip_id, t, round(max(x) over o + sum(x) over o / 3, 6) as x from fe window o as (partition by clip_id order by t rows between 1 preceding and 1 following)",
    "pool_blocks": f"with {ENERGY} select clip_id, (t // 2)::int as t, round(avg(x), 6) as mean, round(max(x), 6) as largest from fe where t < 12 group by clip_id, t // 2",
    "upsample_pad": f"with {ENERGY} select clip_id, i::int as t, round(x, 6) as x from range(60) as r(i) join fe on t = least(i // 4, 12)",
    "attention_pool": f"with {ENERGY}, a as (select clip_id, exp(least(greatest(x - 2, -10), 10)) as e, 1 / (1 + exp(-(x * 0.5 - 1))) as c from fe) select clip_id, round(sum(e * c) / sum(e), 6) as score from a group by 1",
    "pooling_head": f"with {ENERGY} select clip_id, round(max(x) + avg(x), 6) as x from fe group by 1",
    "time_tags": "select doc_id as i, (doc_id % 50)::double as from_s, (60 + doc_id % 60)::double as to_s, 'take ' || (doc_id // 3) as plain, '1m' || (doc_id % 60) || 's' as to_text from documents",
    "twin_files": f"""with n as (select 'take ' || (i // 3) || ' ' || {SCENES} as name from (select doc_id as i from documents) where not (i % 3 = 1 and i % 4 = 0) and not (i % 3 = 2 and i % 5 = 0))
        select name as high, coalesce((select any_value(m.name) from n m where m.name = replace(n.name, '96kHz', '44kHz')), (select any_value(m.name) from n m where m.name = replace(n.name, '96kHz', '44.1kHz'))) as low from n where name like '%96kHz'""",
    "parse_time": "select doc_id as path, case doc_id % 6 when 0 then (doc_id % 9) * 60 + doc_id % 60 when 1 then doc_id % 100 end::double as seconds, doc_id % 6 in (0, 1, 2, 4) as valid from documents",
    "next_run": "select (max(doc_id) + 1)::int as next_run from documents",
    "best_checkpoint": """with e as (select o_custkey as run, o_orderdate::date as epoch, max(o_totalprice) / 1e6 as a from orders group by all)
        select run, epoch::varchar as epoch, a > coalesce(greatest(max(a) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), 0), 0) as saved from e""",
    "event_share": SHARE.format(start="strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S')", share="round(count(*) filter (value > 60) / nullif(count(*) filter (value > 20), 0), 6)"),
    "stream_share": SHARE.format(start="strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S')", share="round(count(*) filter (value > 60) / nullif(count(*) filter (value > 20), 0), 6)"),
    "event_bursts": """with g as (select user_id, ts, coalesce(ts >= lag(ts) over (partition by user_id order by ts) + interval 30 minutes, true) as fresh from events),
        b as (select *, sum(fresh::int) over (partition by user_id order by ts rows unbounded preceding) as k from g)
        select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as n from b group by user_id, k""",
}
