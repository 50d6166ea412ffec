"""Exact Jaccard join of word n-grams with pivots and regions (operator 10).

Two documents link when the Jaccard similarity of their shingle sets is at
least NEAR percent, a distance of at most 1 - NEAR / 100.  Documents with equal
sets are one node.

Regions.  Unrelated texts are all at distance 1 from each other and from any
document, so regions around documents alone would leave one region with nearly
everything.  The first pivots are therefore the shingles themselves, as sets of
one element.  All shingles have one order; the pivot of a document's own cell
is its first shingle, and by the bound on the overlap a document near to it has
that shingle among its first n - ceil(n * NEAR / 100) + 1.  Each document is
copied into the regions of so many of its first shingles: the window around the
border beyond which no near document can be.  Shingles that crowd a region
stand last in the order, so regions are small except where documents consist of
crowded shingles.

Clusters.  A region of at most SMALL documents gives pairs, which sketches of the
sets thin out; a larger one holds its documents together.  What these pairs and
regions connect is a cluster: near documents are always in one.  The set of a
document travels once, to its cluster, which one task joins exactly.

Recursion.  A cluster of more than CLUSTER shingles is first joined anew: all its
shingles are counted and stand in the order of their counts, so that most of its
documents leave it by shingles that are rare there.  Clusters that are still too
large are divided by documents as pivots.  Each document is measured against all of them and linked to the near
ones; it belongs to the region of its nearest pivot, and by the triangle
inequality a document near to it can be in another region only if that one's
pivot is no farther than twice the near distance beyond its nearest.  It is
copied into those regions.  A document that is linked to the pivot of a region
leaves it where the pivot's distances to all that are not are larger by more than
the near distance.  Regions are divided again until one task can join them.
Where copies would outweigh the division, as documents are about as far from all
pivots, pairs of blocks of the cluster are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .storage import exact, saved

#: Words of a shingle, and the similarity in percent at which two documents link.
SHINGLE, NEAR = 4, 85
#: Documents of a region whose pairs are listed; a shingle in more documents than this is crowded.
SMALL = 32
#: Shingles of the sets that one task joins at a time.
CLUSTER = 2_000_000
#: Pivots of a division, and how much larger its regions together may be than what they divide.
PIVOTS, GROWTH = 8, 2
#: Bits of the broadcast maps of hashes, 8 MB; a wrong hit costs time only.
BITS = 1 << 26
#: Bytes of the broadcast table of counts; shingles that share one stand behind where they belong, which costs time only.
SLOTS = 1 << 23
GROUP_CHARS, CHUNK = 32_000_000, 1 << 22
COUNT = np.dtype([("pivot", "<u8"), ("n", "<u4")])
ENTRY = np.dtype([("pivot", "<u8"), ("node", "<i8"), ("n", "<u4"), ("rank", "<u4")])
STAR = np.dtype([("pivot", "<u8"), ("node", "<i8")])
#: The rank that says that a region is large.
LARGE = 0xFFFFFFFF
PARTS = "bucket int, star boolean, data binary"
SETS = "cluster bigint, node bigint, n bigint, shingles binary"


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Which of BITS values of the low bits the hashes of a column have."""
    words = rows.select((F.col(column).bitwiseAND(BITS - 1)).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("x")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[np.asarray(words["w"])] = np.asarray(words["x"]).view(np.uint64)
    return out


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    values = values.view(np.uint64) & np.uint64(BITS - 1)
    return (known[(values >> np.uint64(6)).astype(np.int64)] >> (values & np.uint64(63)) & np.uint64(1)).astype(bool)


def shingle_sets(words: W.Words, size: int, crowded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text, and the distinct shingle hashes of each text in the common order.

    A text of fewer words than size has its whole sequence as one shingle.
    """
    found = W.grams(words.hash, size)
    at = np.flatnonzero(W.inside_text(words, size))
    value, row = found[at], np.searchsorted(words.first, at, side="right") - 1
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        whole = np.array([W.grams(words.hash[words.first[i] : words.first[i + 1]], int(words.count[i]))[0] for i in few], np.uint64)
        value, row = np.concatenate([value, whole]), np.concatenate([row, few])
    order = np.lexsort((value, row) if crowded is None else (value, _in(value, crowded), row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return np.searchsorted(row, np.arange(len(words.first))), value


def _sums(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[edges[1:]] - total[edges[:-1]]


def _names(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    n = np.diff(edges).astype(np.uint64)
    return W.mix(_sums(edges, W.mix(values)) + W.mix(_sums(edges, W.mix(values ^ np.uint64(0x5DEECE66D))) + n)).view(np.int64)


def sketch(values: np.ndarray) -> bytes:
    """How many shingles have each value of their lowest bits; a power of two of counts below 256."""
    bins = 1 << max(0, int(len(values) // 4).bit_length())
    while True:
        count = np.bincount((values & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
        if count.max(initial=0) < 256:
            return count.astype(np.uint8).tobytes()
        bins *= 2


def overlap_bound(a: bytes, b: bytes) -> int:
    """At least the size of the intersection of the two sets."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    bins = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, bins).sum(0), y.reshape(-1, bins).sum(0)).sum())


def _nodes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", CHUNK):
            edges, values = shingle_sets(W.split(batch.column("text"), W.SPACED_FOLDED), size)
            made = [sketch(values[s:e]) for s, e in zip(edges[:-1], edges[1:])]
            yield pa.record_batch([batch.column("id"), batch.column("key"), pa.array(np.diff(edges)), pa.array(_names(edges, values)), pa.array(made, pa.binary())], names=["id", "key", "n", "node", "sketch"])

    return run


def _prefix(n: np.ndarray, near: int) -> np.ndarray:
    """How many first shingles of a set of n must hold one of any set near to it; none where only an equal one is."""
    return np.where(100 * (n - 1) >= near * n, n - (near * n + 99) // 100 + 1, 0)


def _first(size: int, near: int, crowded: np.ndarray | None, batch: pa.RecordBatch) -> np.ndarray:
    """An entry for each region that a document of the batch is copied into; equal sets count once."""
    edges, values = shingle_sets(W.split(batch.column("text"), W.SPACED_FOLDED), size, crowded)
    n = np.diff(edges)
    nodes = _names(edges, values)
    once = np.zeros(len(nodes), bool)
    once[np.unique(nodes, return_index=True)[1]] = True
    take = np.where(once, _prefix(n, near), 0)
    row = np.repeat(np.arange(len(n)), take)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
    out = np.empty(len(row), ENTRY)
    out["pivot"], out["node"], out["n"], out["rank"] = values[edges[row] + rank], nodes[row], n[row], rank
    return out


def _dealt(rows: np.ndarray, by: np.ndarray, buckets: int, star: bool) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket, column by column."""
    if len(rows):
        bucket = (W.mix(by.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        pack = zstandard.ZstdCompressor(level=1)
        data = [pack.compress(b"".join(np.ascontiguousarray(rows[c][s:e]).tobytes() for c in rows.dtype.names)) for s, e in zip(heads, np.append(heads[1:], len(bucket)))]
        yield pa.record_batch([pa.array(bucket[heads]), pa.array([star] * len(heads)), pa.array(data, pa.binary())], names=["bucket", "star", "data"])


def _unpacked(data: list[bytes], kind: np.dtype) -> np.ndarray:
    unpack, parts = zstandard.ZstdDecompressor(), [np.zeros(0, kind)]
    for raw in map(unpack.decompress, data):
        own, at = np.empty(len(raw) // kind.itemsize, kind), 0
        for c in kind.names:
            own[c] = np.frombuffer(raw, kind[c], len(own), at)
            at += own[c].nbytes
        parts.append(own)
    return np.concatenate(parts)


def _counts(size: int, near: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", CHUNK):
            pivot, n = np.unique(_first(size, near, None, batch)["pivot"], return_counts=True)
            rows = np.empty(len(pivot), COUNT)
            rows["pivot"], rows["n"] = pivot, n
            yield from _dealt(rows, pivot, buckets, False)

    return run


def _crowded(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, n = _totals(batches)
        yield pa.record_batch([pa.array(pivot[n > limit].view(np.int64))], names=["pivot"])

    return run


def _sent(rows: np.ndarray, crowded: np.ndarray, small: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries on their way to their regions; of a region that is known to be large only what holds it together goes on."""
    _, at, group, n = np.unique(rows["pivot"], return_index=True, return_inverse=True, return_counts=True)
    large = crowded | (n > small)[group]
    own = rows[large]
    # A document is tied to its first large region, and that one to the next: many documents share these ties.
    last = np.append(own["node"][1:] != own["node"][:-1], True) if len(own) else np.zeros(0, bool)
    first = np.append(True, last[:-1]) if len(own) else last
    ties = np.empty(len(own), STAR)
    ties["pivot"] = own["pivot"]
    ties["node"][first] = own["node"][first]
    ties["node"][~first] = W.mix(own["pivot"])[:-1][~first[1:]].view(np.int64)
    ties = np.unique(ties)
    yield from _dealt(ties, ties["node"], buckets, True)
    # A crowded shingle is large wherever it comes; of another one the other tasks are told.
    known = rows[at[(n > small) & ~crowded[at]]]
    known["rank"] = LARGE
    rows = np.concatenate([rows[~large], known])
    yield from _dealt(rows, rows["pivot"], buckets, False)


def _entries(size: int, near: int, small: int, shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", CHUNK):
            rows = _first(size, near, shared.value, batch)
            yield from _sent(rows, _in(rows["pivot"], shared.value), small, buckets)

    return run


def _recounts(buckets: int):
    """All shingles of sets, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "shingles", CHUNK):
            pivot, n = np.unique(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64), return_counts=True)
            rows = np.empty(len(pivot), COUNT)
            rows["pivot"], rows["n"] = pivot, n
            yield from _dealt(rows, pivot, buckets, False)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.sort(_unpacked([x for batch in batches for x in batch.column("data").to_pylist()], COUNT), order="pivot")
    heads = np.flatnonzero(np.concatenate([[True], rows["pivot"][1:] != rows["pivot"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    return rows["pivot"][heads], np.add.reduceat(rows["n"].astype(np.int64), heads) if len(rows) else heads


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The order of magnitude of the counts, by the low bits of shingles that more than one set holds."""
    pivot, n = _totals(batches)
    pivot, n = pivot[n > 1], n[n > 1]
    yield pa.record_batch([pa.array((pivot & np.uint64(SLOTS - 1)).astype(np.int32)), pa.array(np.log2(n).astype(np.int32))], names=["slot", "level"])


def _reordered(near: int, small: int, shared, buckets: int):
    """Entries of sets whose shingles stand in the order of their counts; those that no other set holds make no region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "shingles", CHUNK):
            n = np.asarray(batch.column("n"))
            values, row = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64), np.repeat(np.arange(len(n)), n)
            level = shared.value[(values & np.uint64(SLOTS - 1)).astype(np.int64)]
            order = np.lexsort((values, level, row))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keep = (rank < _prefix(n, near)[row]) & (level[order] > 0)
            rows = np.empty(keep.sum(), ENTRY)
            rows["pivot"], rows["rank"] = values[order][keep], rank[keep]
            rows["node"], rows["n"] = np.asarray(batch.column("node"))[row[keep]], n[row[keep]]
            yield from _sent(rows, np.zeros(len(rows), bool), small, buckets)

    return run


def _possible(near: int, na, nb, ra, rb):
    """Sizes na <= nb and ranks of the first common shingle admit a near pair."""
    least = (near * (na + nb) + 99 + near) // (100 + near)
    return (100 * na >= near * nb) & (1 + np.minimum(na - ra - 1, nb - rb - 1) >= least)


def _regions(near: int, small: int):
    """Pairs of the small regions; members of the larger ones, with the region."""

    def stars(pivot: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(W.mix(pivot).view(np.int64))], names=["a", "b", "region"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for batch in batches:
            rows = _unpacked(batch.filter(batch.column("star")).column("data").to_pylist(), STAR)
            yield stars(np.ascontiguousarray(rows["pivot"]), np.ascontiguousarray(rows["node"]))
            data += batch.filter(pc.invert(batch.column("star"))).column("data").to_pylist()
        x = _unpacked(data, ENTRY)
        del data
        x = x[np.lexsort((x["node"], x["n"], x["pivot"]))]
        if not len(x):
            return
        new = np.ones(len(x), bool)
        new[1:] = (x["pivot"][1:] != x["pivot"][:-1]) | (x["node"][1:] != x["node"][:-1])
        heads = np.flatnonzero(np.concatenate([[True], x["pivot"][1:] != x["pivot"][:-1]]))
        told = np.maximum.reduceat(x["rank"], heads) == LARGE
        size = np.add.reduceat(new.astype(np.int64), heads)
        n = np.diff(np.append(heads, len(x)))
        told, size = np.repeat(told, n)[new], np.repeat(size, n)[new]
        pivot, node, n, rank = x["pivot"][new], x["node"][new], x["n"][new].astype(np.int64), x["rank"][new].astype(np.int64)
        some = (size > 1) & (size <= small) & ~told
        p, d, m, r = pivot[some], node[some], n[some], rank[some]
        pairs = []
        for step in range(1, small):
            i = np.flatnonzero(p[step:] == p[:-step]) if len(p) > step else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[_possible(near, m[i], m[i + step], r[i], r[i + step])]
            pairs.append(np.stack([np.minimum(d[i], d[i + step]), np.maximum(d[i], d[i + step])], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "region"])
        many = (size > small) | told
        yield stars(pivot[many], node[many])

    return run


def _bounded(near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            top = np.array([overlap_bound(a, b) for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())], np.int64)
            keep = pa.array(100 * top >= near * (na + nb - top))
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _sets(size: int, shared):
    """The sets of the documents whose keys are in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pa.array(_in(np.asarray(batch.column("key")), shared.value)))
            for part in W.slices([wanted], "text", CHUNK):
                edges, values = shingle_sets(W.split(part.column("text"), W.SPACED_FOLDED), size)
                yield pa.record_batch([part.column("key"), pa.array([values[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:])], pa.binary())], names=["key", "shingles"])

    return run


class Sets:
    """Some sets in one array, with the overlap of pairs of them."""

    def __init__(self, shingles: list[bytes]):
        self.n = np.array([len(x) // 8 for x in shingles], np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        _, self.term, df = np.unique(np.frombuffer(b"".join(shingles), np.uint64), return_inverse=True, return_counts=True)
        self.df = df[self.term]
        shared = self.df > 1
        self.width = int(self.term.max(initial=0)) + 1
        own, self.common = self.row[shared], self.term[shared]
        self.at = np.searchsorted(own, np.arange(len(self.n) + 1))
        self.cells = np.sort(own * self.width + self.common)

    def overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        size = self.at[i + 1] - self.at[i]
        ends, low = np.cumsum(size), 0
        while low < len(i):
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + (1 << 20), side="right")))
            n = size[low:high]
            term = self.common[np.repeat(self.at[i[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            cell = np.repeat(j[low:high], n) * self.width + term
            at = np.minimum(np.searchsorted(self.cells, cell), max(0, len(self.cells) - 1))
            hit = self.cells[at] == cell if len(self.cells) else np.zeros(len(cell), bool)
            out[low:high] = np.bincount(np.repeat(np.arange(high - low), n), hit, high - low).astype(np.int64)
            low = high
        return out


class Forest:
    """Components of numbered nodes."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the links joined two components."""
        news = np.zeros(len(i), bool)
        for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
            while self.root[a] != a:
                self.root[a] = a = self.root[self.root[a]]
            while self.root[b] != b:
                self.root[b] = b = self.root[self.root[b]]
            if a != b:
                self.root[max(a, b)], news[k] = min(a, b), True
        while (above := self.root[self.root]).tolist() != self.root.tolist():
            self.root = above
        return news


def near_links(group: np.ndarray, shingles: list[bytes], near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect every component of near sets; sets of different groups are not compared.

    The order of the shingles is by their number of documents here, so a set
    shares its first ones with few.
    """
    sets, links = Sets(shingles), [np.zeros((2, 0), np.int64)]
    forest = Forest(len(group))
    order = np.lexsort((sets.term, sets.df, sets.row))
    row = sets.row[order]
    rank = np.arange(len(row)) - np.repeat(np.cumsum(sets.n) - sets.n, sets.n)
    first = (rank < _prefix(sets.n, near)[row]) & (sets.df[order] > 1)
    term, row, rank = sets.term[order][first], row[first], rank[first]
    order = np.lexsort((rank, row, sets.n[row], term, group[row]))
    term, row, rank = term[order], row[order], rank[order]

    def measure(i: np.ndarray, j: np.ndarray) -> None:
        i, j = np.minimum(i, j), np.maximum(i, j)
        pair = np.unique(i * len(group) + j)
        i, j = pair // len(group), pair % len(group)
        both = sets.overlap(i, j)
        good = 100 * both >= near * (sets.n[i] + sets.n[j] - both)
        new = forest.join(i[good], j[good])
        links.append(np.stack([i[good][new], j[good][new]]))

    if len(term):
        cell = np.concatenate([[0], np.cumsum((term[1:] != term[:-1]) | (group[row[1:]] != group[row[:-1]]))])
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        # The set of least rank is the most central one: it is the pivot that the others are measured against first.
        central = np.lexsort((row, rank, cell))[heads]
        i, j = row[central][cell], row
        measure(i[i != j], j[i != j])
        i, j, most, step = [], [], 0, 1
        while len(cell) > step:
            if step & (step - 1) == 0:  # cells of no more members than this are done
                left = np.bincount(cell)[cell] > step
                cell, row, rank = cell[left], row[left], rank[left]
            k = np.flatnonzero(cell[step:] == cell[:-step])
            if len(k):
                k = k[_possible(near, sets.n[row[k]], sets.n[row[k + step]], rank[k], rank[k + step])]
                k = k[forest.root[row[k]] != forest.root[row[k + step]]]
                i.append(row[k])
                j.append(row[k + step])
                most += len(k)
            if most > 200_000:
                measure(np.concatenate(i), np.concatenate(j))
                i, j, most = [], [], 0
            step += 1
        if most:
            measure(np.concatenate(i), np.concatenate(j))
    i, j = np.concatenate(links, axis=1)
    return i, j


def _joined(near: int):
    """Links within each cluster; the rows of a cluster stand together."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        node = np.asarray(table["node"])
        i, j = near_links(np.asarray(table["cluster"]), table["shingles"].to_pylist(), near)
        return pa.record_batch([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            cluster, n = np.asarray(batch.column("cluster")), np.asarray(batch.column("n"))
            heads = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]])) if len(cluster) else np.zeros(0, np.int64)
            sizes, start = np.add.reduceat(n, heads).tolist() if len(heads) else [], 0
            for s, own, more in zip(heads.tolist(), cluster[heads].tolist(), sizes):
                if size > CLUSTER // 2 and own != last:
                    yield flush([*waiting, batch.slice(start, s - start)])
                    waiting, size, start = [], 0, s
                size, last = size + more, own
            waiting.append(batch.slice(start))
        if waiting:
            yield flush(waiting)

    return run


def _divided(near: int):
    """For a part of a cluster and the pivots of the cluster: links of the sets to near pivots, and their regions with the distances to their pivots."""

    def run(part: pa.Table, pivots: pa.Table) -> pa.Table:
        n, reach = np.asarray(part["n"]), 1 - near / 100
        values = np.frombuffer(b"".join(part["shingles"].to_pylist()), np.uint64)
        ends = np.cumsum(n)
        distance, linked = [], []
        for shingles in pivots["shingles"].to_pylist():
            own = np.frombuffer(shingles, np.uint64)
            hits = np.concatenate([[0], np.cumsum(np.isin(values, own))])
            both = hits[ends] - hits[ends - n]
            union = n + len(own) - both
            distance.append(1 - both / union)
            linked.append(100 * both >= near * union)
        distance, linked = np.stack(distance), np.stack(linked)
        inside = distance <= distance.min(axis=0) + 2 * reach + 1e-9
        k, i = np.nonzero(inside | linked)
        node, pivot = np.asarray(part["node"])[i], np.asarray(pivots["node"])[k]
        here, near_to = inside[k, i], linked[k, i]
        columns = [np.asarray(part["cluster"])[i], pa.array(pivot, mask=~here), node, n[i], distance[k, i], pa.array(pivot, mask=~near_to)]
        return pa.table(dict(zip(("cluster", "region", "node", "n", "distance", "link"), columns)))

    return run


class Join:
    """The steps over one table of documents (id, key, text); key tells rows apart that differ."""

    def __init__(self, documents: DataFrame, size: int, near: int, small: int, cluster: int):
        self.docs, self.size, self.near, self.small, self.cluster = documents, size, near, small, cluster
        self.spark: SparkSession = documents.sparkSession
        self.nodes = saved(documents.mapInArrow(_nodes(size), "id bigint, key bigint, n bigint, node bigint, sketch binary"))
        # One document stands for all with its set.
        self.sets = saved(self.nodes.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def regions(self) -> DataFrame:
        """Pairs a, b of small regions; members a of large ones."""
        chars = self.docs.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(8, chars // GROUP_CHARS)
        counted = self.docs.mapInArrow(_counts(self.size, self.near, buckets), PARTS).repartitionById(buckets, "bucket").mapInArrow(_crowded(self.small), "pivot bigint")
        shared = self.spark.sparkContext.broadcast(bitmap(counted, "pivot"))
        sent = self.docs.mapInArrow(_entries(self.size, self.near, self.small, shared, buckets), PARTS)
        return saved(sent.repartitionById(buckets, "bucket").mapInArrow(_regions(self.near, self.small), "a bigint, b bigint, region bigint"))

    def clusters(self) -> DataFrame:
        """cluster with its rows and size in shingles, node, n and shingles of all that may have a near one."""
        found = self.regions()
        members = saved(self.held(found))
        shared = self.spark.sparkContext.broadcast(bitmap(members, "key"))
        # Rows alike in id and text have one key, so a set may come more than once.
        shingles = self.docs.select("key", "text").mapInArrow(_sets(self.size, shared), "key bigint, shingles binary").dropDuplicates(["key"])
        return saved(members.join(shingles, "key").drop("key"))

    def held(self, found: DataFrame) -> DataFrame:
        """cluster, its rows and size, node, key and n: what pairs and large regions hold together."""
        of = lambda k: self.sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        pairs = found.where("region is null").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
        pairs = pairs.mapInArrow(_bounded(self.near), "a bigint, b bigint")
        edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(found.where("region is not null").select("a", "region").distinct())
        members = components(edges).join(self.sets.select("node", "key", "n"), "node")
        sizes = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).where("rows > 1")
        return members.join(sizes, "component").select(F.col("component").alias("cluster"), "rows", "size", "node", "key", "n")

    def reordered(self, rest: DataFrame) -> DataFrame:
        """Clusters of what is in large ones, by regions of shingles in the order of their counts there."""
        shingles = rest.agg(F.sum("n")).first()[0]
        buckets = max(8, 6 * shingles // GROUP_CHARS)
        counted = rest.select("shingles").mapInArrow(_recounts(buckets), PARTS).repartitionById(buckets, "bucket").mapInArrow(_levels, "slot int, level int")
        slots = counted.groupBy("slot").agg(F.max("level").cast("tinyint").alias("level")).toArrow()
        table = np.zeros(SLOTS, np.uint8)
        table[np.asarray(slots["slot"])] = np.asarray(slots["level"])
        sent = rest.select("node", "n", "shingles").mapInArrow(_reordered(self.near, self.small, self.spark.sparkContext.broadcast(table), buckets), PARTS)
        found = saved(sent.repartitionById(buckets, "bucket").mapInArrow(_regions(self.near, self.small), "a bigint, b bigint, region bigint"))
        members = self.held(found).drop("key", "n")
        return saved(rest.select("node", "n", "shingles").join(members, "node"))

    def joined(self, clusters: DataFrame) -> DataFrame:
        """Links a, b of clusters of bounded size."""
        return clusters.repartition("cluster").sortWithinPartitions("cluster").select("cluster", "node", "n", "shingles").mapInArrow(_joined(self.near), "a bigint, b bigint")

    def links(self) -> DataFrame:
        """a and b: enough links to connect every component."""
        clusters = self.clusters()
        large = (F.col("size") > self.cluster) & (F.col("rows") > 2)
        found, rest = saved(self.joined(clusters.where(~large))), clusters.where(large)
        if not rest.isEmpty():
            clusters = self.reordered(rest)
            found, rest = saved(found.union(self.joined(clusters.where(~large)))), clusters.where(large)
        while not rest.isEmpty():
            links, ready, rest = self.divided(rest)
            found = saved(found.union(links).union(self.joined(ready)))
        return found

    def divided(self, rest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """One division of clusters: links to pivots, regions to join, regions to divide again."""
        parts = F.ceil(F.col("size") / (self.cluster / 4)).cast("int")
        slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
        pivots = rest.groupBy("cluster", "size", slot.alias("slot")).agg(F.min_by(F.struct("node", "n", "shingles"), F.xxhash64("node", F.lit(1))).alias("p"))
        pivots = pivots.select("cluster", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "p.*")
        part = F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")
        dealt = rest.select("cluster", part.alias("part"), "node", "n", "shingles").groupBy("cluster", "part").cogroup(pivots.groupBy("cluster", "part"))
        seen = saved(dealt.applyInArrow(_divided(self.near), "cluster bigint, region bigint, node bigint, n bigint, distance double, link bigint"))
        links = seen.where("link is not null and link <> node").select(F.col("node").alias("a"), F.col("link").alias("b"))
        reach = 1 - self.near / 100 + 1e-9
        cells = seen.where("region is not null")
        border = cells.where("link is null").groupBy("cluster", "region").agg((F.min("distance") - reach).alias("border"))
        cells = cells.join(border, ["cluster", "region"]).where(F.col("link").isNull() | (F.col("distance") >= F.col("border")))
        own = cells.groupBy("cluster", "region").agg(F.sum("n").alias("part"), F.count("*").alias("of")).where("of > 1")
        total = own.groupBy("cluster").agg(F.sum("part").alias("parts"), F.max("part").alias("most")).join(rest.select("cluster", "size").distinct(), "cluster")
        bad = saved(total.where((F.col("parts") > GROWTH * F.col("size")) | (F.col("most") > 0.8 * F.col("size"))).select("cluster"))
        own = saved(own.join(bad, "cluster", "left_anti"))
        cells = cells.select("cluster", "region", "node").join(own, ["cluster", "region"]).join(rest.select("cluster", "node", "n", "shingles"), ["cluster", "node"])
        cells = saved(cells.select(F.xxhash64("cluster", "region").alias("cluster"), F.col("of").alias("rows"), F.col("part").alias("size"), "node", "n", "shingles"))
        done = (F.col("size") <= self.cluster) | (F.col("rows") <= 2)
        shape = ["cluster", "node", "n", "shingles"]
        return links, cells.where(done).select(shape).union(self.blocks(rest.join(bad, "cluster", "left_semi"))), cells.where(~done)

    def blocks(self, rest: DataFrame) -> DataFrame:
        """Each pair of blocks of a cluster as a cluster."""
        parts = F.ceil(F.col("size") * 2 / self.cluster).cast("int")
        out = rest.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
        out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return out.select(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("cluster"), "node", "n", "shingles")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, near: int = NEAR, small: int = SMALL, cluster: int = CLUSTER) -> DataFrame:
    """doc_id, n_shingles and component_id, one row for each document.

    Words are runs without ASCII white space, A-Z as a-z.  Documents without
    words have no shingles, link with nothing and are their own component.
    component_id is the smallest doc_id of all that links reach; rows that
    repeat an id get the same component.  A null id never names a component
    with other documents in it; alone its component is null.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("id", "text"))
    join = Join(docs, size, near, small, cluster)
    graph = components(join.links().select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = join.nodes.drop("sketch").join(graph, "node", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    least = nodes.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    out = nodes.join(least, "component", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """documents, of each group of near duplicates only the one of the smallest id.

    Rows without words and rows with a null id stay; of rows that repeat id and
    text one stays.
    """
    columns = [exact(c) for c in documents.columns]
    found = saved(near_duplicates(documents, doc_id, text, **options).select(doc_id, "component_id"))
    gone = found.where(F.col("component_id") < F.col(doc_id)).select(doc_id).distinct()
    kept = documents.join(gone, doc_id, "left_anti").select(*columns)
    repeated = saved(found.groupBy(doc_id).count().where(f"count > 1 and {doc_id} is not null").select(doc_id))
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, doc_id, "left_anti").select(*columns).union(kept.join(repeated, doc_id, "left_semi").select(*columns).dropDuplicates([doc_id, text]))
