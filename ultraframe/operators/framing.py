"""Files, labels, segments and sample-level statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import dot


def label_map(files: DataFrame) -> DataFrame:
    """class and label: the place of each class in sorted order, from 0."""
    return files.select("class").distinct().withColumn("label", (F.row_number().over(Window.orderBy("class")) - 1).cast("int"))


def file_index(files: DataFrame) -> DataFrame:
    """files with the label of their class; there are as many labels as classes, so Spark may broadcast them."""
    return files.join(label_map(files), "class")


def segment_index(files: DataFrame, segment: int, overlap: float = 0.5) -> DataFrame:
    """path, label, start for each segment that fits in its file; shorter files have none but keep their label."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    step = max(1, int(segment * (1 - overlap)))
    fits = file_index(files).where(F.col("n_frames") >= segment)
    return fits.select("path", "label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_frames") - segment, F.lit(step).cast("bigint"))).alias("start"))


def resampled_length(n_frames: Column, rate: int, to: int) -> Column:
    return (n_frames / F.lit(float(rate)) * F.lit(float(to))).cast("bigint")


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def rms(samples: Column) -> Column:
    return F.sqrt(dot(samples, samples) / F.size(samples))


def peak_normalized(samples: Column, eps: float = 1e-6) -> Column:
    return F.transform(samples, lambda x: x / (peak(samples) + eps))


def level(clips: DataFrame, eps: float = 1e-6) -> DataFrame:
    """clip_id, class, rms, peak, and rms after peak normalization."""
    out = clips.select("clip_id", "class", rms(F.col("samples")).alias("rms"), peak(F.col("samples")).alias("peak"))
    return out.withColumn("rms_normalized", F.col("rms") / (F.col("peak") + eps))


def next_valid(levels: DataFrame, threshold: float) -> DataFrame:
    """For each clip of a class the next one, itself included and round the end, that is loud enough; null if none is."""
    w = Window.partitionBy("class").orderBy("clip_id")
    loud = F.when(F.round("rms_normalized", 9) >= threshold, F.col("clip_id"))
    after = F.first(loud, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return levels.select("clip_id", "class", F.coalesce(after, F.min(loud).over(Window.partitionBy("class"))).alias("used"))


def exact_split(frame: DataFrame, key: str, share: float, group: str | None = None, seed: int = 42) -> DataFrame:
    """frame with is_train: exactly int(share * n) rows, or groups, are not for training.

    The cut is the hash of that rank, found by counting, so no task orders all rows.
    """
    unit, bits = group or key, 52
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(unit).cast("string"))), 1, bits // 4), 16, 10).cast("bigint")
    hashed = frame.select(unit).distinct().withColumn("_h", digest)
    n = hashed.count()
    n_val = int(share * n)
    if n_val == 0:
        return frame.withColumn("is_train", F.lit(True))
    cell = F.shiftright("_h", bits - 12).cast("int")
    counts = hashed.groupBy(cell.alias("cell")).count().orderBy("cell").collect()  # at most 4096 rows
    before, at = 0, counts[-1]["cell"]
    for row in counts:
        if before + row["count"] >= n_val:
            at = row["cell"]
            break
        before += row["count"]
    edge = hashed.where(cell == at).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(at)).orderBy("_h", unit)))
    edge = edge.select(F.col(unit).alias("_unit"), (F.col("_r") > n_val - before).alias("_late"))
    out = frame.withColumn("_h", digest).join(edge, F.col(unit) == F.col("_unit"), "left")
    return out.withColumn("is_train", F.when(cell == at, F.col("_late")).otherwise(cell > at)).drop("_h", "_unit", "_late")


def mixup(frame: DataFrame, lam: float) -> DataFrame:
    """Mixes the row of place i of a batch with that of place n - 1 - i; columns batch, place, batch_size, samples."""
    other = frame.select("batch", (F.col("batch_size") - 1 - F.col("place")).alias("place"), F.col("samples").alias("_other"))
    return frame.join(other, ["batch", "place"]).withColumn("samples", F.zip_with("samples", "_other", lambda a, b: a * lam + b * (1 - lam))).drop("_other")


def shuffled(frame: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """frame with place: a new order of each group's rows, the same for the same seed; an epoch takes the next seed."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return frame.withColumn("place", F.row_number().over(order))
