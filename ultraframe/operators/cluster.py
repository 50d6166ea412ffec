"""Affinities between components, and clusterings of them.

Components are a long table (k, i, x): x is a spectrum over i, or an activation
over time.  There are about ten of them; the pairs are of components, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clip
from .factors import STACK
from .spectral import log_mel, mfcc, population_skew, shape

#: Groups whose components are looked at together.
GROUPS = 1000


def pair_sums(x: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The columns of by, a, b and the sums that cosines and correlations need, for a <= b."""
    a, b = x.select(*by, F.col("k").alias("a"), "i", F.col("x").alias("xa")), x.select(*by, F.col("k").alias("b"), "i", F.col("x").alias("xb"))
    both = a.join(b, [*by, "i"]).where("a <= b")
    return both.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.sum("xa").alias("sa"), F.sum("xb").alias("sb"), F.sum(F.col("xa") * F.col("xa")).alias("saa"), F.sum(F.col("xb") * F.col("xb")).alias("sbb"), F.sum(F.col("xa") * F.col("xb")).alias("sab"))


def cosine_affinity(x: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    cosine = F.col("sab") / F.nullif(F.sqrt("saa") * F.sqrt("sbb"), F.lit(0.0))
    return pair_sums(x, by).select(*by, "a", "b", ((F.coalesce(cosine, F.lit(0.0)) + 1) / 2).alias("weight"))


def correlation_affinity(x: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(r + 1) / 2; a constant component correlates with nothing."""
    n = F.col("n")
    spread = F.greatest(n * F.col("saa") - F.col("sa") * F.col("sa"), F.lit(0.0)) * F.greatest(n * F.col("sbb") - F.col("sb") * F.col("sb"), F.lit(0.0))
    r = (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.nullif(F.sqrt(spread), F.lit(0.0))
    return pair_sums(x, by).select(*by, "a", "b", ((F.coalesce(r, F.lit(0.0)) + 1) / 2).alias("weight"))


def blended(spectral: DataFrame, temporal: DataFrame, temporal_weight: float, by: tuple[str, ...] = ()) -> DataFrame:
    joined = spectral.withColumnRenamed("weight", "s").join(temporal.withColumnRenamed("weight", "t"), [*by, "a", "b"])
    return joined.select(*by, "a", "b", clip(F.col("s") * (1 - temporal_weight) + F.col("t") * temporal_weight).alias("weight"))


def ward(x: np.ndarray, n: int) -> np.ndarray:
    """Labels of n clusters, merging the pair whose merge adds least to the squared distances, of equals the first.

    The cost of a merged cluster follows from those of its two parts, so members are looked at once.
    """
    return wards(x[None], n)[0]


def wards(x: np.ndarray, n: int) -> np.ndarray:
    """ward of each of a stack of matrices of one shape."""
    g, m = x.shape[:2]
    cost = np.stack([((x - x[:, i : i + 1]) ** 2).sum(-1) / 2 for i in range(m)], axis=1)
    cost[:, np.arange(m), np.arange(m)] = np.inf
    every, below = np.arange(g), np.tri(m, dtype=bool)
    size, label = np.ones((g, m)), np.tile(np.arange(m), (g, 1))
    for _ in range(m - max(1, n)):
        i, j = np.divmod(np.where(below, np.inf, np.round(cost, 9)).reshape(g, -1).argmin(axis=1), m)
        to_i, to_j, one, other = cost[every, i], cost[every, j], size[every, i][:, None], size[every, j][:, None]
        others = np.isfinite(to_i) & np.isfinite(to_j)
        with np.errstate(invalid="ignore"):
            both = np.where(others, ((one + size) * to_i + (other + size) * to_j - size * cost[every, i, j][:, None]) / (one + other + size), to_i)
        cost[every, i], cost[every, :, i] = both, both
        cost[every, j], cost[every, :, j] = np.inf, np.inf
        size[every, i] += size[every, j]
        label = np.where(label == j[:, None], i[:, None], label)
    number = np.cumsum(label == np.arange(m), axis=1) - 1
    return np.take_along_axis(number, label, axis=1)


def kmeans(x: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Labels of the best of ten k-means, numbered by their first members."""
    rng = np.random.default_rng(seed)
    best, least = np.zeros(len(x), int), np.inf
    for _ in range(10):
        centre = x[rng.choice(len(x), n, replace=False)]
        for _ in range(300):
            label = ((x[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            new = np.stack([x[label == i].mean(0) if (label == i).any() else centre[i] for i in range(n)])
            if np.allclose(new, centre):
                break
            centre = new
        loss = ((x - centre[label]) ** 2).sum()
        if loss < least:
            best, least = label, loss
    _, first, label = np.unique(best, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def spectral(affinity: np.ndarray, n: int, seed: int = 42) -> np.ndarray:
    """Labels from the smallest eigenvectors of the normalized Laplacian, then k-means."""
    d = 1 / np.sqrt(np.maximum(affinity.sum(axis=1), 1e-12))
    _, vectors = np.linalg.eigh(np.eye(len(d)) - d[:, None] * affinity * d[None, :])
    return kmeans(vectors[:, :n] * d[:, None], n, seed)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return rows.pivot(index="k", columns="i", values="x").sort_index().fillna(0.0).to_numpy()


def _places(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row's code among those of its group in order, and how many codes each group has."""
    pairs, which = np.unique(np.stack([group, code], axis=1), axis=0, return_inverse=True)
    count = np.bincount(pairs[:, 0])
    return (np.arange(len(pairs)) - (np.cumsum(count) - count)[pairs[:, 0]])[which.ravel()], count


def cluster_ward(components: DataFrame, n: int) -> DataFrame:
    """group, k, cluster for the components (group, k, i, x) of each group; as many clusters as components if n is not less.

    Groups with as many components and features are clustered in stacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, GROUPS):
                part = batch.slice(first, GROUPS)
                lists = part.column("c")
                group, rows = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists))), lists.flatten()
                ks, x = np.asarray(rows.field("k")), np.nan_to_num(np.asarray(rows.field("x"), dtype=np.float64), nan=0.0, posinf=np.inf, neginf=-np.inf)
                k, m = _places(group, ks)
                i, d = _places(group, np.unique(rows.field("i").to_numpy(zero_copy_only=False), return_inverse=True)[1])
                if len(np.unique(np.stack([group, k, i], axis=1), axis=0)) < len(group):
                    raise ValueError("a component has a feature twice")
                for size in np.unique(np.stack([m, d], axis=1), axis=0):
                    alike = np.flatnonzero((m == size[0]) & (d == size[1]))
                    most = max(1, STACK // max(1, int(size[0] * (size[0] + size[1]))))
                    for at in range(0, len(alike), most):
                        own = alike[at : at + most]
                        place = np.full(part.num_rows, -1)
                        place[own] = np.arange(len(own))
                        mine = place[group] >= 0
                        matrix, names = np.zeros((len(own), *size)), np.zeros((len(own), size[0]), np.int32)
                        matrix[place[group[mine]], k[mine], i[mine]] = x[mine]
                        names[place[group[mine]], k[mine]] = ks[mine]
                        labels = np.tile(np.arange(size[0]), (len(own), 1)) if n >= size[0] else wards(matrix, n)
                        yield pa.record_batch([part.column("group").take(pa.array(np.repeat(own, size[0]))), pa.array(names.ravel()), pa.array(labels.ravel().astype(np.int32))], names=["group", "k", "cluster"])

    rows = components.groupBy("group").agg(F.collect_list(F.struct("k", "i", "x")).alias("c"))
    return rows.mapInArrow(run, f"group {components.schema['group'].dataType.simpleString()}, k int, cluster int")


def cluster_components(components: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """group, k, cluster by k-means over the components (group, k, i, x) of each group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ks = np.sort(rows["k"].unique())
        return pd.DataFrame({"group": rows["group"].iloc[0], "k": ks, "cluster": kmeans(_matrix(rows), min(n, len(ks)), seed)})

    return components.groupBy("group").applyInPandas(run, f"group {components.schema['group'].dataType.simpleString()}, k int, cluster int")


def cluster_spectral(affinities: DataFrame, n: int) -> DataFrame:
    """group, k, cluster from affinities (group, a, b, weight)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ks = np.sort(pd.unique(rows[["a", "b"]].to_numpy().ravel()))
        at = {k: i for i, k in enumerate(ks)}
        m = np.eye(len(ks))
        for a, b, w in zip(rows["a"], rows["b"], rows["weight"]):
            m[at[a], at[b]] = m[at[b], at[a]] = w
        labels = np.arange(len(ks)) if n >= len(ks) else spectral(m, n)
        return pd.DataFrame({"group": rows["group"].iloc[0], "k": ks, "cluster": labels})

    return affinities.groupBy("group").applyInPandas(run, f"group {affinities.schema['group'].dataType.simpleString()}, k int, cluster int")


def cluster_power(affinity: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """k and cluster by power iteration."""
    from pyspark.ml.clustering import PowerIterationClustering

    pic = PowerIterationClustering(k=n, maxIter=20, initMode="degree", weightCol="weight")
    found = pic.assignClusters(affinity.where("a <> b").select(F.col("a").cast("bigint").alias("src"), F.col("b").cast("bigint").alias("dst"), "weight"))
    return found.select(F.col("id").cast("int").alias("k"), "cluster")


def cluster_kmeans(rows: DataFrame, columns: str, n: int, seed: int = 42) -> DataFrame:
    """rows with cluster, by k-means over a column of arrays."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("features", array_to_vector(columns))
    return KMeans(k=n, seed=seed, maxIter=300).fit(data).transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def cluster_sums(long: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, i and the sum of x over the components (k, i, x) that labels (k, cluster) put in it."""
    return long.join(labels, "k").groupBy("cluster", "i").agg(F.sum("x").alias("x"))


def members(activations: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, its components in order, how many they are, and the energy of their activations."""
    energy = activations.groupBy("k").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    return energy.join(labels, "k").groupBy("cluster").agg(F.array_sort(F.collect_list("k")).alias("components"), F.count("*").alias("n"), F.sum("e").alias("energy"))


def features(spectra: DataFrame, activations: DataFrame, rate: int, n_fft: int, mels: int, keep: int, by: tuple[str, ...] = (), correlations: bool = True) -> DataFrame:
    """The columns of by, k, name, x: cepstra, centroid, rolloff, flatness, skew and correlations of components, each feature standardized.

    spectra and activations are (by, k, i, x) over bins and over frames.
    """
    keys = (*by, "k")
    own = F.struct(*keys).alias("clip_id")
    cells = spectra.select(own, F.lit(0).alias("t"), F.col("i").alias("k"), (F.col("i") * float(rate) / n_fft).alias("freq"), F.greatest("x", F.lit(1e-10)).alias("mag"))
    of_row = lambda frame, name, value: frame.select(*[F.col(f"clip_id.{c}").alias(c) for c in keys], name.alias("name"), value.alias("x"))
    mfccs = mfcc(log_mel(cells, rate, n_fft, mels), mels, keep)
    shapes = shape(cells)
    parts = [of_row(mfccs, F.concat(F.lit("mfcc_"), F.col("c")), F.col("mfcc"))]
    parts += [of_row(shapes, F.lit(c), F.col(c)) for c in ("centroid", "rolloff", "flatness")]
    parts.append(population_skew(activations, keys, "x").select(*keys, F.lit("skew").alias("name"), F.col("skew").alias("x")))
    if correlations:
        pairs = correlation_affinity(activations, by).withColumn("r", 2 * F.col("weight") - 1)
        for this, other in (("a", "b"), ("b", "a")):
            parts.append(pairs.where("true" if this == "a" else "a < b").select(*by, F.col(this).alias("k"), F.concat(F.lit("corr_"), F.col(other)).alias("name"), F.col("r").alias("x")))
    return standardized(reduce(DataFrame.unionByName, parts), by)


def standardized(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, k, name, x with each feature less its mean, over its population deviation; a constant one, or one that is null, becomes 0."""
    w = Window.partitionBy(*by, "name")
    spread = F.stddev_pop("x").over(w)
    return long.select(*by, "k", "name", F.coalesce(F.when(spread > 1e-12, (F.col("x") - F.avg("x").over(w)) / spread), F.lit(0.0)).alias("x"))


def labelled(spectra: DataFrame, activations: DataFrame, n: int, method: str, rate: int, n_fft: int, mels: int, keep: int, temporal_weight: float = 0.6) -> DataFrame:
    """clip_id, k, cluster for the components (clip_id, k, i, x) of each clip: agglomerative and k-means by all features, spectral by timbre and common activity."""
    by, group = ("clip_id",), lambda frame: frame.withColumnRenamed("clip_id", "group")
    if method in ("agglomerative", "k-means"):
        rows = group(features(spectra, activations, rate, n_fft, mels, keep, by)).withColumnRenamed("name", "i")
        found = (cluster_ward if method == "agglomerative" else cluster_components)(rows, n)
    elif method == "spectral":
        timbre = features(spectra, activations, rate, n_fft, mels, keep, by, correlations=False).withColumnRenamed("name", "i")
        found = cluster_spectral(group(blended(cosine_affinity(timbre, by), correlation_affinity(activations, by), temporal_weight, by)), n)
    else:
        raise ValueError(f"no clustering named {method}")
    return found.withColumnRenamed("group", "clip_id")
