"""Queries of training by batches, of inference to votes and of convolution, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import argmax, relu
from ..operators import batches, evaluate, pooling, spectral
from ..sources import tables as T
from ..sources.storage import shared_folder
from . import oracles as O
from .queries import _cells, r

CLASSES, BATCHES, EPOCHS, RATE, SEED = 10, 4, 2, 0.01, 7


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.clips(spark, sf).withColumn("is_train", F.col("clip_id") % 5 != 0)


def _trained(spark: SparkSession, sf: str) -> tuple[batches.Softmax, list[dict]]:
    return batches.train(_rows(spark, sf), "clip_id", "samples", "class", CLASSES, BATCHES, EPOCHS, RATE, SEED)


def train_epochs(spark: SparkSession, sf: str) -> DataFrame:
    log = _trained(spark, sf)[1]
    found = spark.createDataFrame([(e["epoch"], e["loss"], e["train_accuracy"], e["accuracy"], e["saved"]) for e in log], "epoch int, loss double, train_accuracy double, accuracy double, saved boolean")
    return found.select("epoch", r("loss"), r("train_accuracy"), r("accuracy"), "saved")


def voted_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Segments scored by the trained model, batch by batch, and voted on file by file."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    batches.save(spark, _trained(spark, sf)[0], path)
    score = batches.scorer(path, 64)
    scored = T.clips(spark, sf).withColumn("scores", score("samples"))
    pred = argmax(F.transform("scores", lambda p: F.round(p, 9)))
    rows = scored.select((F.col("class") * 100 + F.col("clip_id") % 7).cast("bigint").alias("file_id"), F.col("clip_id").alias("start"), F.col("class").alias("label"), pred.alias("pred"))
    return evaluate.majority_vote(rows)


def _kernel(spark: SparkSession, channels: int, out: int, seed: int) -> DataFrame:
    """3 x 3 weights that a formula defines."""
    grid = spark.range(9 * channels * out).select(*[F.expr(e).cast("int").alias(n) for n, e in (("dt", f"id % 3 - 1"), ("dk", "id div 3 % 3 - 1"), ("c", f"id div 9 % {channels}"), ("out", f"id div {9 * channels}"))])
    return grid.withColumn("weight", ((F.col("dt") * 5 + F.col("dk") * 3 + F.col("c") * 2 + F.col("out") * 7 + 20 + seed) % 11 - 5) / 10.0)


def conv_block(spark: SparkSession, sf: str) -> DataFrame:
    frames = spectral.magnitude(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP))
    found = pooling.conv_frames(frames, [_kernel(spark, 1, 2, 0), _kernel(spark, 2, 3, 1)])
    return found.select("clip_id", "t", "k", "c", r("x", 5))


def pooled_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Largest and mean over time of each bin, added, through a linear layer and without what is negative."""
    pooled = _cells(spark, sf).groupBy("clip_id", F.col("k").alias("i")).agg((F.max("mag") + F.avg("mag")).alias("x"))
    grid = spark.range(9 * 4).select((F.col("id") % 9).cast("int").alias("i"), F.expr("id div 9").cast("int").alias("out"))
    weights = grid.withColumn("weight", ((F.col("i") * 7 + F.col("out") * 5) % 11 - 5) / 10.0)
    bias = spark.range(4).select(F.col("id").cast("int").alias("out"), (F.col("id") / 4.0).alias("bias"))
    return pooling.dense(pooled, weights, bias).select("clip_id", "out", r(relu(F.col("x")), name="x"))


QUERIES = {f.__name__: f for f in (train_epochs, voted_inference, conv_block, pooled_dense)}


def _training() -> str:
    """CTEs of all steps: th{n} are weights and moments, e{epoch} the log of an epoch."""
    parts = [
        f"xs as materialized (select clip_id, class as y, n as d, x from s union all select vec_id, label, 64, 1.0 from embeddings)",
        f"th0 as (select d::int as d, c::int as c, 0.0::double as w, 0.0::double as m, 0.0::double as v from range(65) as a(d), range({CLASSES}) as b(c))",
    ]
    n, best = 0, "0.0"
    for epoch in range(1, EPOCHS + 1):
        losses = []
        for batch in range(BATCHES):
            own = f"clip_id % 5 <> 0 and ('0x' || md5('{SEED}|{epoch}|' || clip_id)[1:8])::bigint % {BATCHES} = {batch}"
            n += 1
            parts += [
                f"lo{n} as (select clip_id, any_value(y) as y, c, sum(x * w) as z from xs join th{n - 1} using (d) where {own} group by clip_id, c)",
                f"p{n} as materialized (select clip_id, y, c, exp(z - max(z) over g) / sum(exp(z - zm)) over g as p from (select *, max(z) over (partition by clip_id) as zm from lo{n}) window g as (partition by clip_id))",
                f"g{n} as materialized (select d, c, sum(x * (p - (p{n}.y = c)::int)) / (select count(distinct clip_id) from p{n}) as g from p{n} join xs using (clip_id) group by d, c)",
                f"""th{n} as materialized (select d, c, w - {RATE} * (mm / (1 - pow(0.9::double, {n}))) / (sqrt(vv / (1 - pow(0.999::double, {n}))) + 1e-8) as w, mm as m, vv as v
                    from (select d, c, w, 0.9::double * m + (1 - 0.9::double) * g as mm, 0.999::double * v + (1 - 0.999::double) * g * g as vv from th{n - 1} join g{n} using (d, c)))""",
                f"l{n} as (select avg(-ln(p)) filter (c = y) as loss, count(*) filter (c = y) as n, count(*) filter (c = y and k = c) as hit from (select *, first(c) over (partition by clip_id order by round(p, 12) desc, c) as k from p{n}))",
            ]
            losses.append(f"from l{n}")
        parts += [
            f"va{epoch} as (select avg((y = k)::int) as a from (select clip_id, any_value(y) as y, first(c order by round(z, 9) desc, c) as k from (select clip_id, any_value(y) as y, c, sum(x * w) as z from xs join th{n} using (d) where clip_id % 5 = 0 group by clip_id, c) group by 1))",
            f"e{epoch} as materialized (select {epoch}::int as epoch, avg(loss) as loss, sum(hit) / sum(n) as train_accuracy, (select a from va{epoch}) as accuracy, (select a from va{epoch}) > {best} as saved from ({' union all '.join(losses)}))",
        ]
        best = f"greatest({', '.join(f'(select a from va{e})' for e in range(1, epoch + 1))}, 0)"
    return ",\n".join(parts)


def _convolution() -> str:
    def kernel(channels: int, out: int, seed: int) -> str:
        return f"(select dt, dk, c, o, ((dt * 5 + dk * 3 + c * 2 + o * 7 + 20 + {seed}) % 11 - 5) / 10.0::double as weight from range(-1, 2) as a(dt), range(-1, 2) as b(dk), range({channels}) as d(c), range({out}) as e(o))"

    parts, now = ["c0 as (select clip_id, t, k, 0 as c, mag as x from cells)"], "c0"
    for i, size in enumerate(((1, 2), (2, 3)), 1):
        parts += [
            f"u{i} as materialized (select clip_id, t - dt as t, k - dk as k, o as c, sum(x * weight) as x from {now} join {kernel(*size, i - 1)} using (c) where t - dt between 0 and 12 and k - dk between 0 and 8 group by all)",
            f"c{i} as materialized (select clip_id, t, k, c, greatest((x - avg(x) over w) / sqrt(var_pop(x) over w + 1e-5), 0) as x from u{i} window w as (partition by c))",
        ]
        now = f"c{i}"
    return ",\n".join(parts)


SQL = {
    "train_epochs": f"with {O.CLIPS}, {_training()} select epoch, round(loss, 6) as loss, round(train_accuracy, 6) as train_accuracy, round(accuracy, 6) as accuracy, saved from ({' union all '.join(f'from e{e}' for e in range(1, EPOCHS + 1))})",
    "voted_inference": f"""with {O.CLIPS}, {_training()},
        lg as (select clip_id, any_value(y) as y, c, sum(x * w) as z from xs join th{BATCHES * EPOCHS} using (d) group by clip_id, c),
        sm as (select clip_id, y, c, round(exp(z - zm) / sum(exp(z - zm)) over (partition by clip_id), 9) as p from (select *, max(z) over (partition by clip_id) as zm from lg)),
        pr as (select (any_value(y) * 100 + clip_id % 7)::bigint as file_id, clip_id as start, any_value(y) as label, first(c order by p desc, c)::int as pred from sm group by clip_id),
        v as (select file_id, pred, count(*) as n, min(start) as f from pr group by all), b as (select file_id, first(pred order by n desc, f) as pred from v group by 1)
        select file_id, arg_max(label, start) as label, any_value(b.pred) as pred from pr join b using (file_id) group by 1""",
    "pooled_dense": f"with {O.CELLS}, p as (select clip_id, k, max(mag) + avg(mag) as x from cells group by all) select clip_id, o::int as out, round(greatest(sum(x * (((k * 7 + o * 5) % 11 - 5) / 10.0::double)) + o / 4.0::double, 0), 6) + 0.0 as x from p, range(4) as q(o) group by clip_id, o",
    "conv_block": f"with {O.CELLS}, {_convolution()} select clip_id, (t // 2)::int as t, (k // 2)::int as k, c::int as c, round(avg(x), 5) + 0.0 as x from c2 where t < 12 and k < 8 group by all",
}
