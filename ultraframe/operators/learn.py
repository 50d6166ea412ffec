"""Training and choosing classifiers over feature vectors, with MLlib."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import argmax, logit

#: Classifiers by name; each takes the length of the features and the number of classes.
REGISTRY = {
    "logistic": lambda width, classes, seed: LogisticRegression(maxIter=30, regParam=0.01),
    "perceptron": lambda width, classes, seed: MultilayerPerceptronClassifier(layers=[width, 32, classes], maxIter=50, seed=seed),
}

LOADERS = {"logistic": LogisticRegressionModel, "perceptron": MultilayerPerceptronClassificationModel}


def train(rows: DataFrame, name: str = "logistic", features: str = "samples", label: str = "class", width: int = 64, classes: int = 10, seed: int = 42):
    data = rows.where("is_train").select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    return REGISTRY[name](width, classes, seed).fit(data)


def predict(model, rows: DataFrame, features: str = "samples") -> DataFrame:
    out = model.transform(rows.withColumn("features", array_to_vector(features)))
    return out.withColumn("scores", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def scores_as_logits(rows: DataFrame, batch: str, scores: str = "scores") -> DataFrame:
    """Scores of batches that lie within [0, 1] as logits; others stay as they are."""
    w = Window.partitionBy(batch)
    low, high = F.min(F.array_min(scores)).over(w), F.max(F.array_max(scores)).over(w)
    return rows.withColumn(scores, F.when((low >= 0) & (high <= 1), F.transform(scores, lambda p: logit(p))).otherwise(F.col(scores)))


def predicted(scores: Column) -> Column:
    """The class of the largest score, the first of equals."""
    return argmax(scores)


def best_so_far(epochs: DataFrame, run: str = "run") -> DataFrame:
    """epochs (run, epoch, accuracy) with saved: whether accuracy exceeds 0 and all before."""
    before = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return epochs.withColumn("saved", F.col("accuracy") > F.coalesce(F.greatest(F.max("accuracy").over(before), F.lit(0.0)), F.lit(0.0)))


def save(model, path: str) -> None:
    """Writes a fitted model, over another one."""
    model.write().overwrite().save(path)


def load(name: str, path: str):
    """The model of a registered name from a folder."""
    return LOADERS[name].load(path)
