"""Evaluation of predicted labels, by segment and by file.

Frames hold label and pred.  Only counts by pair of classes leave the rows, so
everything after the first aggregate is as small as the number of classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import ratio


def majority_vote(preds: DataFrame) -> DataFrame:
    """file_id, label, pred: the most common prediction, of equals the one first met; the label of the last segment."""
    votes = preds.groupBy("file_id", "pred").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    best = votes.groupBy("file_id").agg(F.max_by("pred", F.struct("n", -F.col("first"))).alias("pred"))
    labels = preds.groupBy("file_id").agg(F.max_by("label", "start").alias("label"))
    return labels.join(best, "file_id")


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("label") == F.col("pred")).cast("double")), F.lit(0.0)).alias("accuracy"))


def pair_counts(preds: DataFrame) -> DataFrame:
    return preds.groupBy("label", "pred").agg(F.count("*").alias("n"))


def scores_by_class(preds: DataFrame) -> DataFrame:
    """class, tp, n_true, n_pred, precision, recall, f1 of the classes met as label or prediction; 0 for an empty ratio."""
    counts = pair_counts(preds)
    sides = counts.select(F.col("label").alias("class"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p")).union(
        counts.select("pred", F.lit(0), F.lit(0), "n")
    )
    out = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    precision, recall = F.coalesce(ratio(F.col("tp"), F.col("n_pred")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("n_true")), F.lit(0.0))
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", F.coalesce(ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(0.0)))


def macro_scores(preds: DataFrame) -> DataFrame:
    """Means over the classes met as label or prediction."""
    return scores_by_class(preds).agg(*[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")])


def confusion(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """label, pred, n and share of the label's row, for all pairs of the known classes (column class)."""
    # Pairs of classes, not of rows.
    grid = labels.select(F.col("class").alias("label")).crossJoin(labels.select(F.col("class").alias("pred")))
    out = grid.join(pair_counts(preds), ["label", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.coalesce(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("label"))), F.lit(0.0)))


def class_report(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """name, precision, recall, f1, support for each known class, with a macro and a weighted mean over all of them."""
    own = labels.select("class").join(scores_by_class(preds), "class", "left").na.fill(0).select("class", "precision", "recall", "f1", F.col("n_true").alias("support"))
    measures = ("precision", "recall", "f1")
    macro = own.agg(F.lit("macro avg").alias("name"), *[F.avg(c).alias(c) for c in measures], F.sum("support").alias("support"))
    weighted = own.agg(F.lit("weighted avg").alias("name"), *[F.coalesce(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c) for c in measures], F.sum("support").alias("support"))
    return own.select(F.col("class").cast("string").alias("name"), *measures, "support").union(macro).union(weighted)


def mean_batch_loss(losses: DataFrame, batch: str = "batch", loss: str = "loss") -> DataFrame:
    """loss and n: the mean over batches of each one's mean, so a short batch counts as much as a full one."""
    return losses.groupBy(batch).agg(F.avg(loss).alias("_l")).agg(F.avg("_l").alias("loss"), F.count("*").alias("n"))
