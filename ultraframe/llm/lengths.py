"""Token counts by an exact length histogram (operator 7).

Documents are encoded once and aggregated by encoded length.  The histogram is
all that the later questions need: suffix sums over it give, for every context
limit, the documents and tokens beyond it and the tokens left after cutting,
and quantiles are a walk along it.  The suffix sums are in two levels, so no
task holds the whole histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def token_lengths(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """documents with n_tokens; null and empty texts have 0.

    The vocabulary file is read by the driver and broadcast (50,256 entries).
    """
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(_ranks(vocabulary))
    documents = documents.drop("n_tokens")

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.withColumn("n_tokens", count(F.col(text)))


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """n_tokens and n_docs, one row for each length that occurs; written, so that texts are encoded once."""
    return saved(lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count("*").alias("n_docs")))


def limits(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: what is within and beyond it.

    docs_over and tokens_over are of the documents longer than the limit;
    truncated_tokens is the sum of min(length, limit) over all documents;
    share_within is the share of documents not over the limit, so the quantile
    q is the least n_tokens whose share_within is at least q.
    """
    h = histogram.withColumn("_block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_tokens"))
    up = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy()
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(up), F.lit(0)).alias("_docs_up"),
        F.coalesce(F.sum("_tokens").over(up), F.lit(0)).alias("_tokens_up"),
        F.sum("_docs").over(every).alias("all_docs"),
        F.sum("_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    out = h.join(blocks, "_block")
    out = out.withColumn("docs_over", F.coalesce(F.sum("n_docs").over(within), F.lit(0)) + F.col("_docs_up"))
    out = out.withColumn("tokens_over", F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(within), F.lit(0)) + F.col("_tokens_up"))
    out = out.withColumn("truncated_tokens", F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens"))
    out = out.withColumn("share_within", 1 - F.col("docs_over") / F.col("all_docs"))
    return out.select("n_tokens", "n_docs", "docs_over", "tokens_over", "truncated_tokens", "share_within", "all_docs", "all_tokens")


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share q of the documents does not exceed."""
    return limits.where(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))
