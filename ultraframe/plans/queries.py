"""The queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scalar import argmax, logit
from ..operators import activity, cluster, evaluate, framing, learn, pooling, separation, spectral
from ..sources import tables as T
from ..sources.storage import shared_folder
from ..streaming.activity import bursts, windowed_share

AUDIBLE, SNR, PLAYING, LEAST, WINDOW = 20.0, 20.0, -8.0, -70.0, 0.25
SEGMENT, MELS, KEEP = 800, 4, 3


def r(c: str | Column, places: int = 6, name: str | None = None) -> Column:
    """Rounded for comparison, without negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column, places) + 0.0
    return out.alias(name or c) if isinstance(name or c, str) else out


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.cells(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP), T.RATE, T.N_FFT, T.HOP)


def _db(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.decibel_cells(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP), T.RATE, T.N_FFT, T.HOP)


def _floors(db: DataFrame) -> DataFrame:
    return activity.noise_floors(db, AUDIBLE, snr_db=SNR, least_db=LEAST)


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    db = _db(spark, sf)
    return activity.frames(db, _floors(db), AUDIBLE, PLAYING)


def _spectra(spark: SparkSession, sf: str) -> DataFrame:
    """k, i, x: the mean spectrum of each class, as ten components."""
    return _cells(spark, sf).groupBy(F.col("class").alias("k"), F.col("k").alias("i")).agg(F.avg("mag").alias("x"))


def _activations(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).groupBy(F.col("class").alias("k"), F.col("t").alias("i")).agg(F.avg("mag").alias("x"))


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    return T.clips(spark, sf).select("class").distinct()


def _factors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """v, and factors of three components that a formula defines."""
    v = _cells(spark, sf).select("clip_id", F.col("k").alias("f"), "t", F.col("mag").alias("v"))
    ks = spark.range(3).select(F.col("id").cast("int").alias("k"))
    w = v.select("clip_id", "f").distinct().crossJoin(F.broadcast(ks)).select("clip_id", "f", "k", ((1 + (F.col("f") * 3 + F.col("k") * 5) % 7) / 7.0).alias("w"))
    h = v.select("clip_id", "t").distinct().crossJoin(F.broadcast(ks)).select("clip_id", "k", "t", ((1 + (F.col("t") * 2 + F.col("k") * 3) % 5) / 5.0).alias("h"))
    return v, w, h


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    v, w, h = _factors(spark, sf)
    return separation.component_power(w, h)


def file_index(spark: SparkSession, sf: str) -> DataFrame:
    return framing.file_index(T.files(spark, sf)).select("path", "class", "label", "n_frames")


def label_map(spark: SparkSession, sf: str) -> DataFrame:
    return framing.label_map(T.files(spark, sf))


def segment_index(spark: SparkSession, sf: str) -> DataFrame:
    return framing.segment_index(T.files(spark, sf), SEGMENT)


def clip_level(spark: SparkSession, sf: str) -> DataFrame:
    return framing.level(T.clips(spark, sf)).select("clip_id", r("rms"), r("peak"), r("rms_normalized"))


def pad_or_trim(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.scalar import dot, pad_or_trim

    x = pad_or_trim(F.col("samples"), 48)
    return T.clips(spark, sf).select("clip_id", F.size(x).alias("n"), r(dot(x, x), name="energy"))


def next_valid(spark: SparkSession, sf: str) -> DataFrame:
    return framing.next_valid(framing.level(T.clips(spark, sf)), 0.45)


def stft_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).select("clip_id", "t", "k", "freq", "time_s", r("mag"))


def stft_relational(spark: SparkSession, sf: str) -> DataFrame:
    x = spectral.stft_relational(T.clips(spark, sf), T.N_FFT, T.HOP)
    return x.select("clip_id", "t", "k", r(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), name="mag"))


def spectrogram_db(spark: SparkSession, sf: str) -> DataFrame:
    return _db(spark, sf).select("clip_id", "t", "k", (F.col("mag_db") + 0.0).alias("mag_db"))


def noise_floors(spark: SparkSession, sf: str) -> DataFrame:
    return _floors(_db(spark, sf)).select("clip_id", *[r(c, 4) for c in ("noise_global_db", "noise_audible_db", "noise_ultra_db", "global_threshold_db", "ultra_threshold_db")])


def pua_frame(spark: SparkSession, sf: str) -> DataFrame:
    return activity.share_of_frames(_frames(spark, sf)).select("clip_id", "n_play_frames", "n_ultra_frames", r("pua_frame"))


def pua_sec(spark: SparkSession, sf: str) -> DataFrame:
    return activity.share_of_windows(_frames(spark, sf), WINDOW).select("clip_id", "n_windows", r("pua_sec"))


def frequency_counts(spark: SparkSession, sf: str) -> DataFrame:
    db = _db(spark, sf)
    floors = _floors(db)
    return activity.frequency_counts(db, floors, activity.frames(db, floors, AUDIBLE, PLAYING))


def top_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return activity.top_frequency(_frames(spark, sf))


def top_frequency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return activity.histogram(activity.top_frequency(_frames(spark, sf)), "top_freq")


def price_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return activity.histogram(T.table(spark, sf, "orders"), "o_totalprice")


def ultrasonic_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = activity.summary(_db(spark, sf), AUDIBLE, SNR, LEAST, PLAYING, WINDOW)
    as_double = lambda c: F.col(c).cast("double").alias(c) if c.startswith("max") else c
    return found.select(*[r(c, 4) if c.startswith("noise") else as_double(c) for c in found.columns])


def log_mel(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.log_mel(_cells(spark, sf), T.RATE, T.N_FFT, MELS).select("clip_id", "t", "mel", r("log_mel"))


def mfcc(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.mfcc(spectral.log_mel(_cells(spark, sf), T.RATE, T.N_FFT, MELS), MELS, KEEP).select("clip_id", "t", "c", r("mfcc"))


def spectral_shape(spark: SparkSession, sf: str) -> DataFrame:
    return spectral.shape(_cells(spark, sf)).select("clip_id", r("centroid"), "rolloff", r("flatness"))


def activation_skew(spark: SparkSession, sf: str) -> DataFrame:
    per_frame = _cells(spark, sf).groupBy("clip_id", "t").agg(F.sum("mag").alias("x"))
    return spectral.population_skew(per_frame, "clip_id", "x").select("clip_id", r("skew", 5))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return T.predictions(spark, sf)


def logit_argmax(spark: SparkSession, sf: str) -> DataFrame:
    s = F.transform("samples", lambda x: F.abs(x) * 4)
    kept = F.transform(F.transform(s, lambda p: F.least(p, F.lit(1.0))), lambda p: F.round(logit(p), 9))
    return T.clips(spark, sf).select("clip_id", argmax(kept).alias("pred"), r(F.array_max(kept), name="top"))


def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.majority_vote(T.predictions(spark, sf))


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.accuracy(T.predictions(spark, sf)).select("n", r("accuracy"))


def macro_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.macro_scores(T.predictions(spark, sf)).select(*[r(f"{c}_macro") for c in ("precision", "recall", "f1")])


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(T.predictions(spark, sf), _classes(spark, sf)).select("label", "pred", "n", r("share"))


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.class_report(T.predictions(spark, sf), _classes(spark, sf)).select("name", r("precision"), r("recall"), r("f1"), "support")


def exact_split(spark: SparkSession, sf: str) -> DataFrame:
    return framing.exact_split(T.clips(spark, sf).select("clip_id", "class"), "clip_id", 0.2)


def mixup(spark: SparkSession, sf: str) -> DataFrame:
    mixed = framing.mixup(T.batches(T.clips(spark, sf).select("clip_id", "samples"), "clip_id", 32), 0.7)
    return mixed.select("clip_id", F.posexplode("samples").alias("n", "x")).select("clip_id", "n", r("x"))


def separation_measures(spark: SparkSession, sf: str) -> DataFrame:
    return separation.measures(T.triples(spark, sf), T.RATE).select("clip_id", r("sdr", 5), r("si_sdr", 5), r("sir", 5), "duration_s")


def spectral_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cosine_affinity(_spectra(spark, sf)).select("a", "b", r("weight"))


def temporal_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.correlation_affinity(_activations(spark, sf)).select("a", "b", r("weight"))


def blended_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.blended(cluster.cosine_affinity(_spectra(spark, sf)), cluster.correlation_affinity(_activations(spark, sf)), 0.3).select("a", "b", r("weight"))


def nmf_step_w(spark: SparkSession, sf: str) -> DataFrame:
    return separation.kl_step(*_factors(spark, sf))[0].select("clip_id", "f", "k", r("w"))


def nmf_step_h(spark: SparkSession, sf: str) -> DataFrame:
    return separation.kl_step(*_factors(spark, sf))[1].select("clip_id", "k", "t", r("h"))


def nmf_fit(spark: SparkSession, sf: str) -> DataFrame:
    frames = spectral.magnitude(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP))
    fitted = separation.fit(frames, 3)
    values = [fitted.select("clip_id", F.lit(c).alias("factor"), F.posexplode(c).alias("at", "value"), "error") for c in ("w", "h")]
    return values[0].union(values[1]).select("clip_id", "factor", "at", r("value", 4), r("error", 4))


def soft_mask(spark: SparkSession, sf: str) -> DataFrame:
    return separation.soft_mask(_parts(spark, sf)).select("clip_id", "k", "f", "t", r("m"))


def hard_mask(spark: SparkSession, sf: str) -> DataFrame:
    return separation.hard_mask(_parts(spark, sf))


def median_mask(spark: SparkSession, sf: str) -> DataFrame:
    return separation.median_mask(separation.soft_mask(_parts(spark, sf)), 4).select("clip_id", "k", "f", "t", r("m"))


def refined_mask(spark: SparkSession, sf: str) -> DataFrame:
    return separation.refine(separation.soft_mask(_parts(spark, sf)), 3, 0.2, 0.05).select("clip_id", "k", "f", "t", r("m"))


def istft_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    back = spectral.istft(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP), T.N_FFT, T.HOP)
    return back.select("clip_id", "n", r("x"))


def cluster_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_kmeans(T.clips(spark, sf), "samples", 10).select("clip_id", "cluster")


def cluster_power(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_power(cluster.cosine_affinity(_spectra(spark, sf)), 2)


def _components(spark: SparkSession, sf: str) -> DataFrame:
    """group, k, i, x: the spectra of the three fitted components of each clip."""
    frames = spectral.magnitude(spectral.stft(T.clips(spark, sf), T.N_FFT, T.HOP))
    rows = separation.fit(frames, 3).select(F.col("clip_id").alias("group"), F.posexplode("w").alias("at", "x"))
    return rows.select("group", (F.col("at") % 3).alias("k"), F.floor(F.col("at") / 3).cast("int").alias("i"), "x")


def cluster_ward(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_ward(_components(spark, sf), 2)


def cluster_spectral(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_spectral(cluster.cosine_affinity(_components(spark, sf), ("group",)), 2)


def pool_max_avg3(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.max_avg3(_frame_energy(spark, sf)).select("clip_id", "t", r("x"))


def _frame_energy(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).groupBy("clip_id", "t").agg(F.sum("mag").alias("x"))


def pool_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.blocks(_frame_energy(spark, sf), 2).select("clip_id", "t", r("mean"), r("largest"))


def upsample_pad(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.upsample(_frame_energy(spark, sf), 4, 60).select("clip_id", "t", r("x"))


def attention_pool(spark: SparkSession, sf: str) -> DataFrame:
    x = _frame_energy(spark, sf).select("clip_id", "t", (F.col("x") - 2).alias("att"), (F.col("x") * 0.5 - 1).alias("cla"))
    return pooling.attention(x).select("clip_id", r("score"))


def pooling_head(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.head(_frame_energy(spark, sf)).select("clip_id", r("x"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    ids = T.files(spark, sf).select(F.col("path").alias("i"))
    tag = F.when(F.col("i") % 3 == 0, "96kHz").when(F.col("i") % 3 == 1, "44kHz").otherwise("44.1kHz")
    return ids.select("i", F.concat(F.lit("take "), F.floor(F.col("i") / 3).cast("string"), F.lit(" (0m"), (F.col("i") % 50).cast("string"), F.lit("s_to_1m"), (F.col("i") % 60).cast("string"), F.lit("s) "), tag, F.lit(".wav")).alias("name"))


def time_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = names.time_tag(F.col("name"))
    return _names(spark, sf).select("i", t["from_s"].alias("from_s"), t["to_s"].alias("to_s"), names.plain_name(F.col("name")).alias("plain"), names.format_time(t["to_s"]).alias("to_text"))


def twin_files(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("i") % 3 == 0, "96kHz").when(F.col("i") % 3 == 1, "44kHz").otherwise("44.1kHz")
    # Some takes lack the twin of the first tag, some lack both.
    some = T.files(spark, sf).select(F.col("path").alias("i")).where("not (i % 3 = 1 and i % 4 = 0) and not (i % 3 = 2 and i % 5 = 0)")
    return names.twins(some.select(F.concat(F.lit("take "), F.floor(F.col("i") / 3).cast("string"), F.lit(" "), tag).alias("name")))


def parse_time(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("path")
    text = F.when(i % 6 == 0, F.concat((i % 9).cast("string"), F.lit(":"), (i % 60).cast("string"))).when(i % 6 == 1, (i % 100).cast("string")).when(i % 6 == 2, "END").when(i % 6 == 3, "1:2:3").when(i % 6 == 4, " ").otherwise("soon")
    t = names.parse_time(text)
    return T.files(spark, sf).select("path", t["seconds"].alias("seconds"), t["valid"].alias("valid"))


def next_run(spark: SparkSession, sf: str) -> DataFrame:
    return names.next_run(T.files(spark, sf).select(F.concat(F.lit("x [Run "), F.col("path").cast("string"), F.lit("]")).alias("name")))


def train_logistic(spark: SparkSession, sf: str) -> DataFrame:
    rows = framing.exact_split(T.clips(spark, sf), "clip_id", 0.2)
    out = learn.predict(learn.train(rows), rows)
    return out.select("clip_id", "is_train", F.col("class").alias("label"), learn.predicted(F.col("scores")).alias("pred"))


def best_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    by_day = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run"), F.to_date("o_orderdate").alias("epoch")).agg((F.max("o_totalprice") / 1e6).alias("accuracy"))
    return learn.best_so_far(by_day).select("run", F.col("epoch").cast("string").alias("epoch"), "saved")


def event_share(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_share(T.table(spark, sf, "events"), 20.0, 60.0).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n_play", r("share"))


def stream_share(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows over a stream of the file, until all is read; of each window the last state that came out."""
    folder = f"{shared_folder(spark)}/share-{uuid.uuid4().hex}"
    source = spark.readStream.schema(T.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    share = windowed_share(source, 20.0, 60.0)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/out/batch={batch:06d}")

    # Append would hold back the windows that the last watermark has not passed.
    share.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).schema(share.withColumn("batch", F.lit(0)).schema).parquet(f"{folder}/out")
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n_play", "share"), "batch").alias("x"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "x.n_play", r(F.col("x.share"), name="share"))


def event_bursts(spark: SparkSession, sf: str) -> DataFrame:
    return bursts(T.table(spark, sf, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        file_index, label_map, segment_index, clip_level, pad_or_trim, next_valid, stft_magnitude, stft_relational, spectrogram_db, noise_floors,
        pua_frame, pua_sec, frequency_counts, top_frequency, top_frequency_histogram, price_histogram, ultrasonic_summary, log_mel, mfcc, spectral_shape,
        activation_skew, predictions, logit_argmax, majority_vote, accuracy, macro_scores, confusion, class_report, exact_split, mixup, separation_measures,
        spectral_affinity, temporal_affinity, blended_affinity, nmf_step_w, nmf_step_h, nmf_fit, soft_mask, hard_mask, median_mask, refined_mask,
        istft_round_trip, cluster_kmeans, cluster_power, cluster_ward, cluster_spectral, pool_max_avg3, pool_blocks, upsample_pad, attention_pool,
        pooling_head, time_tags, twin_files, parse_time, next_run, train_logistic, best_checkpoint, event_share, stream_share, event_bursts,
    )
}
