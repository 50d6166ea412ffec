"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), decides on every document that its
predecessor kept, and returns the columns of documents; the last one adds copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ultraframe.llm.decontaminate import decontaminate
from ultraframe.llm.jaccard import one_of_each
from ultraframe.llm.lines import dedup_lines
from ultraframe.llm.mixing import sample
from ultraframe.llm.queries import table
from ultraframe.llm.storage import exact, written
from ultraframe.llm.toxicity import fit, held_out, score
from ultraframe.shipping import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity score of 0.5 or more go."""
    index = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, index).where("score < 0.5").select(*[exact(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that held nothing else."""
    found = dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*[exact(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words a shingle, linked at 80 percent."""
    return one_of_each(docs, size=5, near=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the targets of the sources ask for."""
    return sample(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
]

#: Nearest examples and similarity joins are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written as Parquet and read again as the next one's documents."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
