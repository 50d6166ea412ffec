"""Nearest neighbours by a forest of hash prefixes (operator 8).

Each tree hashes every vector to a string of BITS bits, the signs of random
projections, and keeps the vectors in the order of their strings, so those with
a common prefix stand together.  A prefix that more than 2 * leaf vectors share
is split by its next bit, as far as the strings go; the prefixes that are left
are the homes of the vectors.  A query descends in each tree to the longest
prefix that any vector shares and then ascends all trees together, a bit at a
time, until the homes under its prefixes hold trees * leaf / 2 vectors, and those
of one tree k + 1, or the prefix is empty.  All vectors in those homes are
candidates and are measured exactly on the original vectors.

The largest inner product is made an angle by one more component, the root of
the largest squared norm less the own squared norm; queries have 0 there.
Norms are cut into bands of a factor BAND, each with its own trees and largest
norm, as beside one large norm all others would look alike.  A query visits
every band; one that is not split is measured in one tree.

Equal vectors are one vector with a list of its smallest ids, so copies cost
nothing.  The homes, about 2 * trees / leaf for each vector, are broadcast.  In
each home vectors and queries are dealt into blocks, and each pair of blocks is
measured in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved

#: Trees; vectors under a prefix, about; bits of a string; factor of the norms of a band.
TREES, LEAF, BITS, BAND = 16, 4096, 48, 2**0.5
#: Queries of a block; strings that one task counts.
QUERIES, STRINGS = 4096, 1 << 20
SEED = 7


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null, not zero, and all finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~bad & F.exists(column, lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _planes(trees: int, bits: int, width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width + 1, trees * bits))


def _codes(x: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """For each vector and tree the string of bits as a number."""
    signs = (x @ _planes(trees, bits, x.shape[1] - 1) > 0).reshape(len(x), trees, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _stored(x: np.ndarray, top: float, trees: int, bits: int) -> np.ndarray:
    """For each vector and tree the string behind the number of band and tree."""
    norm = np.sqrt((x * x).sum(axis=1))
    band = np.maximum(np.floor(np.log(top / norm) / np.log(BAND)), 0).astype(np.int64)
    rest = np.sqrt(np.maximum((top / BAND**band) ** 2 - norm * norm, 0.0))
    return (band[:, None] * trees + np.arange(trees) << bits) + _codes(np.column_stack([x, rest]), trees, bits)


def _strings(width: int, top: float, trees: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                strings = _stored(_matrix(whole.slice(at, 512).column("vector"), width), top, trees, bits)
                yield pa.record_batch([pa.array(strings.ravel())], names=["code"])

    return run


def _counted(limit: int, bits: int):
    """Prefixes of a range of strings, with counts, whose parent may be split; those at its ends go on in other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.asarray(x.column("code")), np.asarray(x.column("n"))) for x in batches if x.num_rows]
        if not rows:
            return
        code, n = (np.concatenate(c) for c in zip(*rows))
        order = np.argsort(code)
        code, n = code[order], n[order]
        parents = None
        for level in range(bits + 1):
            prefix = code >> (bits - level)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            heads = np.flatnonzero(new)
            count = np.add.reduceat(n, heads)
            keep = np.ones(len(heads), bool) if parents is None else parents[0][parents[1][heads]]
            yield pa.record_batch([pa.array(np.full(keep.sum(), level, np.int32)), pa.array(prefix[heads][keep]), pa.array(count[keep])], names=["level", "prefix", "n"])
            open_ones = count > limit
            open_ones[[0, -1]] = True
            parents = open_ones, np.cumsum(new) - 1

    return run


class Homes:
    """The homes in the order of their strings: start and end of each, vectors in it, and the longest prefix."""

    def __init__(self, level: np.ndarray, prefix: np.ndarray, n: np.ndarray, limit: int, trees: int, bits: int):
        start, end, count, above = [], [], [], None
        self.trees, self.bits, self.deepest = trees, bits, 0
        for at in range(bits + 1):
            own, size = prefix[level == at], n[level == at]
            if above is not None:
                some = np.isin(own >> 1, above)
                own, size = own[some], size[some]
            else:  # The trees of a band that is not split are alike.
                some = (size > limit) | (own % trees == 0)
                own, size = own[some], size[some]
                self.bands = np.unique(own // trees)
            if not len(own):
                break
            self.deepest = at
            home = (size <= limit) | (at == bits)
            start.append(own[home] << (bits - at))
            end.append(own[home] + 1 << (bits - at))
            count.append(size[home])
            above = own[~home]
        order = np.argsort(np.concatenate(start))
        self.start, self.end, self.count = (np.concatenate(x)[order] for x in (start, end, count))
        self.total = np.concatenate([[0], np.cumsum(self.count)])

    def of(self, strings: np.ndarray) -> np.ndarray:
        """The home of each string of a vector, or -1 in trees that are left out."""
        at = np.searchsorted(self.start, strings, side="right") - 1
        return np.where((at >= 0) & (strings < self.end[at]), at, -1)

    def asked(self, codes: np.ndarray, wanted: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of codes and the homes that they ask."""
        rows, homes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for band in self.bands.tolist():
            strings = (band * self.trees + np.arange(self.trees, dtype=np.int64) << self.bits) + codes
            left = np.arange(len(codes))
            for level in range(self.deepest, -1, -1):
                low = strings[left] >> (self.bits - level) << (self.bits - level)
                first = np.searchsorted(self.end, low, side="right")
                last = np.maximum(np.searchsorted(self.start, low + (1 << (self.bits - level)), side="left"), first)
                found = self.total[last] - self.total[first]
                done = (found.sum(axis=1) >= wanted) & (found.max(axis=1) >= least) | (level == 0)
                n = (last - first)[done].ravel()
                rows.append(np.repeat(np.repeat(left[done], self.trees), n))
                homes.append(np.repeat(first[done].ravel(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                left = left[~done]
                if not len(left):
                    break
        return np.concatenate(rows), np.concatenate(homes)


def _asked(width: int, shared, wanted: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: Homes = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = _matrix(batch.column("vector"), width)
                rows, home = homes.asked(_codes(np.column_stack([x, np.zeros(len(x))]), homes.trees, homes.bits), wanted, least)
                yield pa.record_batch([pa.array(home), batch.column("key").take(pa.array(rows))], names=["home", "key"])

    return run


def _housed(width: int, top: float, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: Homes = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                home = homes.of(_stored(_matrix(batch.column("vector"), width), top, homes.trees, homes.bits))
                row, tree = np.nonzero(home >= 0)
                home, row = home[row, tree], pa.array(row)
                yield pa.record_batch([pa.array(home), batch.column("key").take(row), batch.column("least").take(row), batch.column("vector").take(row)], names=["home", "key", "least", "vector"])

    return run


def _nearest(width: int, k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        stored, queries = group[~asks], group[asks]
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "key": np.zeros(0, np.int64), "least": np.zeros(0, np.int64), "score": np.zeros(0)})
        if stored.empty or queries.empty:
            return empty
        x = np.stack(stored["vector"].to_numpy()).astype(np.float64)
        key, least = stored["key"].to_numpy(), stored["least"].to_numpy()
        found = [empty]
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            score = np.stack(part["vector"].to_numpy()).astype(np.float64) @ x.T
            n = min(k, score.shape[1])
            worst = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
            for i, own in enumerate(part["key"].to_numpy()):
                near = np.flatnonzero(score[i] >= worst[i])
                near = near[np.lexsort((least[near], -score[i][near]))[:k]]
                found.append(pd.DataFrame({"query": own, "key": key[near], "least": least[near], "score": score[i][near]}))
        return pd.concat(found, ignore_index=True)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", column: str = "embedding", trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each row of queries among the other rows of vectors.

    queries must be rows of vectors.  Nearness is the inner product; ties go to
    the smaller id.  Rows with a null id, and vectors that are null, zero or
    hold null or non-finite components, take no part; nor do vectors of another
    length than most have.  Rows that repeat an id and a vector count once.
    Vectors are arrays of floats or of doubles.
    """
    rows = usable(vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(column).alias("vector")), "vector").where("id is not null")
    widths = rows.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).alias("top"))
    most = widths.orderBy(F.desc("n"), "w").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], out)
    width, n, top = most.w, most.n, float(most.top)
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    rows = rows.where(F.size("vector") == width).withColumn("key", F.xxhash64("vector"))
    asked = usable(queries.select(F.col(vec_id).cast("bigint").alias("id"), F.col(column).alias("vector")), "vector").where((F.size("vector") == width) & F.col("id").isNotNull()).select("id", F.xxhash64("vector").alias("key")).distinct()

    # Of equal vectors the k + 1 smallest ids: one may be the query's own.
    first = rows.dropDuplicates(["key", "id"]).withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("place") <= k + 1)
    ids = saved(first.select("key", "id", "vector", "place"))
    asking = asked.select("key").distinct().withColumn("asks", F.lit(True))
    points = ids.where("place = 1").join(asking, "key", "left").select("key", F.col("id").alias("least"), "vector", F.coalesce("asks", F.lit(False)).alias("asks"))

    points = saved(points)
    spark, limit = vectors.sparkSession, 2 * leaf
    cells = saved(points.select("vector").mapInArrow(_strings(width, top, trees, BITS), "code bigint").groupBy("code").agg(F.count("*").alias("n")))
    ranges = max(8, n * trees // STRINGS)
    nodes = cells.repartitionByRange(ranges, "code").mapInArrow(_counted(limit, BITS), "level int, prefix bigint, n bigint").groupBy("level", "prefix").agg(F.sum("n").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast(Homes(*(np.asarray(nodes[c]) for c in ("level", "prefix", "n")), limit, trees, BITS))
    visits = saved(points.where("asks").select("key", "vector").mapInArrow(_asked(width, shared, trees * leaf // 2, k + 1), "home bigint, key bigint"))
    stored = points.select("key", "least", "vector").mapInArrow(_housed(width, top, shared), f"home bigint, key bigint, least bigint, vector array<{kind}>")
    dealt = lambda c: F.pmod(F.xxhash64("key"), c).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    count = spark.createDataFrame(pa.table({"home": np.arange(len(shared.value.count)), "stored": shared.value.count}))
    blocks = visits.groupBy("home").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asking")).join(count, "home")
    blocks = F.broadcast(saved(blocks.select("home", "asking", F.ceil(F.col("stored") / limit).cast("int").alias("blocks"))))
    stored = stored.join(blocks, "home").select("home", dealt("blocks").alias("block"), every("asking").alias("part"), "key", F.lit(False).alias("asks"), "least", "vector")
    visits = visits.join(blocks, "home").select("home", every("blocks").alias("block"), dealt("asking").alias("part"), "key")
    visits = visits.join(points.where("asks").select("key", "least", "vector"), "key").select("home", "block", "part", "key", F.lit(True).alias("asks"), "least", "vector")
    near = stored.unionByName(visits).groupBy("home", "block", "part").applyInPandas(_nearest(width, k + 1), "query bigint, key bigint, least bigint, score double")

    best = near.groupBy("query", "key").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("query", "key", "score")
    # For each distinct query vector the k + 1 nearest ids; then, for each query, without its own.
    named = best.join(ids.select("key", "id"), "key").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    named = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    own = asked.select(F.col("id").alias("query_id"), F.col("key").alias("query")).join(named, "query")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    own = own.select("query_id", F.posexplode(others).alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
