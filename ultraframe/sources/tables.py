"""The driver's tables as recordings, files, series, predictions and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The clips are short: 64 samples at 64 Hz, 13 frames of 16 samples, 9 bins of 4 Hz.
RATE, N_FFT, HOP = 64, 16, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, class, samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("clip_id"), F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("samples"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, class, n_frames."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("class"), F.col("n_chars").alias("n_frames"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, event_id, x: one signal for each user."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("x"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, ref, other, est: a clip, the next one, and the clip with a tenth of the next."""
    c = clips(spark, sf_dir).select("clip_id", "samples")
    nxt = c.select((F.col("clip_id") - 1).alias("clip_id"), F.col("samples").alias("other"))
    both = c.withColumnRenamed("samples", "ref").join(nxt, "clip_id")
    return both.withColumn("est", F.zip_with("ref", "other", lambda a, b: a + 0.1 * b))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, start, label, pred: the class whose mean clip has the largest cosine."""
    c = clips(spark, sf_dir)
    long = c.select("clip_id", "class", F.posexplode("samples").alias("n", "x"))
    means = long.groupBy("class", "n").agg(F.avg("x").alias("m")).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("p"))
    means = means.select(F.col("class").alias("pred"), F.transform("p", lambda p: p["m"]).alias("centre"))
    # One row for each class, 10 in all.
    pairs = c.crossJoin(F.broadcast(means))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("samples", "centre") / F.greatest(F.sqrt(dot("samples", "samples")) * F.sqrt(dot("centre", "centre")), F.lit(1e-12))
    best = pairs.groupBy("clip_id", "class").agg(F.max_by("pred", F.struct(F.round(cosine, 9), -F.col("pred"))).alias("pred"))
    return best.select((F.col("class") * 100 + F.col("clip_id") % 7).cast("bigint").alias("file_id"), F.col("clip_id").alias("start"), F.col("class").alias("label"), "pred")


def batches(frame: DataFrame, order: str, size: int) -> DataFrame:
    """Numbers rows in the order of an id that counts from 0: batch and place in it."""
    return frame.withColumn("batch", F.expr(f"{order} div {size}")).withColumn("place", F.col(order) % size).withColumn("batch_size", F.count("*").over(Window.partitionBy("batch")))
