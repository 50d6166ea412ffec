"""Toxicity by nearest labelled examples (operator 6).

A document is its TF-IDF vector over all words of the labelled examples, with
document frequencies counted over all documents.  Each term is also weighted by
the square of its evidence: the log odds of the term among toxic and other
examples over their standard error.  (Plain TF-IDF finds texts of like subject:
on the sf0.1 tables its neighbours name 28 of 97 held-out toxic documents, these
86.)  No term is left out.

The examples lie in an inverted index: for each term and each block of BLOCK
examples that holds it, the weights there and the largest of them.  The lists of
terms that more than one in HEAD examples holds are full rows, whose part of all
cosines is one product of matrices for many documents.  That part's maximum in a
block and the sum of a query's products with the largest weights there bound
every cosine in the block; blocks are read in the order of their bounds until no
bound exceeds the K-th best cosine, so the K nearest are exact.  Their votes, weighted by nearness and drawn
towards the share of toxic examples, are made a probability by a curve that is
fitted on the examples themselves, each without its own vote.

The index is bounded by EXAMPLES and is broadcast; scoring is one narrow pass
over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .storage import exact, saved

#: Most labelled examples of the index, which bounds the broadcast (about 12 bytes for each term of each).
EXAMPLES = 5_000
BLOCK, K, FIRST_BLOCKS, HEAD = 128, 16, 4, 8
#: Texts of one product of matrices.
TEXTS = 256
#: Votes are weighted 1 / (1 + SOFT - cosine); the prior weighs as much as PRIOR.
SOFT, PRIOR = 0.05, 0.5
#: The curve's slope and shift stay near 1 and 0 as if so many examples said so.
CURVE = 50.0


def terms_of(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count for each term of each text, by row and then term."""
    row = words.text_of()
    order = np.lexsort((words.hash, row))
    row, term = row[order], words.hash[order]
    heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else row
    return row[heads], term[heads], np.diff(np.append(heads, len(row)))


def _known(words: W.Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the sorted vocabulary and count of the terms that are in it."""
    row, term, count = terms_of(words)
    if not len(vocabulary):
        return row[:0], row[:0], count[:0]
    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    hit = vocabulary[at] == term
    return row[hit], at[hit], count[hit]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a hash of the sequence of all words."""
    for batch in W.slices(batches, "text"):
        words = W.split(batch.column("text"), W.ALNUM)
        own = [int(W.grams(words.hash[s:e], int(e - s))[0].view(np.int64)) if e > s else 0 for s, e in zip(words.first[:-1], words.first[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "whole"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches, "text"):
        row, term, count = terms_of(W.split(batch.column("text"), W.ALNUM))
        offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(term.view(np.int64)), pa.array(count.astype(np.int32)))]
        yield pa.record_batch([batch.column("example"), batch.column("toxic"), *lists], names=["example", "toxic", "terms", "counts"])


def _frequencies(shared):
    """Of the terms of the vocabulary, how many documents hold each; one row for each term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, n = shared.value, 0
        total = np.zeros(len(vocabulary), np.int64)
        for batch in W.slices(batches, "text"):
            term = _known(W.split(batch.column("text"), W.ALNUM), vocabulary)[1]
            total += np.bincount(term, minlength=len(vocabulary))
            n += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["term", "n"])

    return run


@dataclass
class Index:
    """Examples by term and block: cells are in the order of terms and, for each, of blocks; rows of the head are full."""

    vocabulary: np.ndarray
    weight: np.ndarray
    row: np.ndarray
    head: np.ndarray
    first: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    start: np.ndarray
    posting: np.ndarray
    value: np.ndarray
    toxic: np.ndarray
    example: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def queries(self, edge: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weights of the terms of several texts, each text of norm 1 (or 0)."""
        value = (1 + np.log(counts)) * self.weight[terms]
        text = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        norm = np.sqrt(np.bincount(text, value * value, len(edge) - 1))
        return value / np.where(norm > 0, norm, 1)[text]

    def base(self, edge: np.ndarray, terms: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The part of the head in the cosines of several texts and all examples."""
        full = np.zeros((len(edge) - 1, len(self.head)), np.float32)
        some = self.row[terms] >= 0
        full[np.repeat(np.arange(len(edge) - 1), np.diff(edge))[some], self.row[terms[some]]] = query[some]
        return full @ self.head

    def nearest(self, terms: np.ndarray, query: np.ndarray, base: np.ndarray, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The K examples of largest cosine above 0, and the cosines; ties to the earlier place.  `but` is left out."""
        tail = self.row[terms] < 0
        terms, query = terms[tail], query[tail]
        n = self.first[terms + 1] - self.first[terms]
        cell = np.repeat(self.first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        factor, blocks = np.repeat(query, n), self.block[cell]
        bound = (np.bincount(blocks, factor * self.largest[cell], len(base) // BLOCK) + base.reshape(-1, BLOCK).max(axis=1)) * (1 + 1e-5)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, found = np.zeros(0, np.int64), np.zeros(0)
        for part in (order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]):
            if len(ids) >= K:
                part = part[bound[part] >= found[K - 1]]
            if not len(part):
                break
            wanted = np.zeros(len(bound), bool)
            wanted[part] = True
            some = wanted[blocks]
            own = cell[some]
            m = self.start[own + 1] - self.start[own]
            at = np.repeat(self.start[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            cosine = base + np.bincount(self.posting[at], self.value[at] * np.repeat(factor[some], m), len(base))
            inside = (part[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            inside = inside[cosine[inside] > 0]
            if but is not None:
                inside = inside[inside != but]
            ids, found = np.concatenate([ids, inside]), np.concatenate([found, cosine[inside]])
            if len(ids) > K:
                few = np.flatnonzero(found >= np.partition(found, len(found) - K)[len(found) - K])
                ids, found = ids[few], found[few]
            best = np.lexsort((ids, -found))[:K]
            ids, found = ids[best], found[best]
        return ids, found

    def raw(self, terms: np.ndarray, query: np.ndarray, base: np.ndarray, but: int | None = None) -> tuple[float, list[int]]:
        """The share of toxic votes before the curve, and the examples that voted."""
        ids, cosine = self.nearest(terms, query, base, but)
        votes = 1 / (1 + SOFT - np.minimum(cosine, 1))
        return float((votes @ self.toxic[ids] + PRIOR * self.prior) / (votes.sum() + PRIOR)), self.example[ids].tolist()

    def curve(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip(raw, 1e-6, 1 - 1e-6)
        return np.where(raw > 0, 1 / (1 + np.exp(-(self.slope * np.log(x / (1 - x)) + self.shift))), 0.0)

    def calibrate(self, raw: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic curve of the votes, with a normal prior around leaving them as they are."""
        z = np.log(np.clip(raw, 1e-3, 1 - 1e-3)) - np.log(1 - np.clip(raw, 1e-3, 1 - 1e-3))
        x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (toxic - p) - CURVE * (w - np.array([1.0, 0.0]))
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + CURVE * np.eye(2), slope)
        self.slope, self.shift = float(max(0.1, w[0])), float(w[1])


def _index(rows: pa.Table, frequency, prior: float) -> Index:
    """The index of rows of example, toxic, terms and counts; frequency gives document frequencies and their number for sorted terms."""
    toxic, example = np.asarray(rows["toxic"]).astype(float), np.asarray(rows["example"])
    lists, counts = rows["terms"].combine_chunks(), np.asarray(rows["counts"].combine_chunks().flatten())
    vocabulary, term = np.unique(np.asarray(lists.flatten()).view(np.uint64), return_inverse=True)
    row = np.repeat(np.arange(len(toxic)), np.diff(np.asarray(lists.offsets)))
    df, n = frequency(vocabulary)
    a = np.bincount(term, toxic[row], len(vocabulary)) + 0.5
    b = np.bincount(term, 1 - toxic[row], len(vocabulary)) + 0.5
    p, q = a / (toxic.sum() + 1), b / ((1 - toxic).sum() + 1)
    evidence = np.log(p * (1 - q) / (q * (1 - p))) ** 2 / (1 / a + 1 / b)
    weight = (np.log((n + 1) / (df + 1)) + 1) * evidence
    value = (1 + np.log(counts)) * weight[term]
    norm = np.sqrt(np.bincount(row, value * value, len(toxic)))
    value /= np.where(norm > 0, norm, 1)[row]
    # Examples with the same heaviest term stand together, so that blocks differ in their bounds.
    heaviest = np.full(len(toxic), -1)
    order = np.lexsort((value, row))
    last = np.append(row[order][1:] != row[order][:-1], True) if len(row) else np.zeros(0, bool)
    heaviest[row[order][last]] = term[order][last]
    place = np.empty(len(toxic), np.int64)
    by_place = np.lexsort((example, heaviest))
    place[by_place] = np.arange(len(toxic))
    row = place[row]
    size = -(-max(1, len(toxic)) // BLOCK) * BLOCK
    common = np.bincount(term, minlength=len(vocabulary)) * HEAD > len(toxic)
    rows_of = np.where(common, np.cumsum(common) - 1, -1)
    head = np.zeros((int(common.sum()), size), np.float32)
    in_head = common[term]
    head[rows_of[term[in_head]], row[in_head]] = value[in_head]
    term, row, value = term[~in_head], row[~in_head], value[~in_head]
    order = np.lexsort((row, term))
    term, row, value = term[order], row[order], value[order]
    block = row // BLOCK
    heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
    largest = np.maximum.reduceat(value, heads) if len(heads) else np.zeros(0)
    first = np.searchsorted(term[heads], np.arange(len(vocabulary) + 1))
    padded, names = np.zeros(size), np.full(size, -1)
    padded[: len(toxic)], names[: len(toxic)] = toxic[by_place], example[by_place]
    return Index(vocabulary, weight, rows_of.astype(np.int32), head, first.astype(np.int32), block[heads].astype(np.int32), largest.astype(np.float32), np.append(heads, len(row)).astype(np.int32), row.astype(np.int32), value.astype(np.float32), padded, names, prior)


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Index:
    """An index of at most `examples` labelled documents.

    labels holds doc_id and label; rows with a null in either teach nothing.
    Where there are more rows than examples, those whose hashed ids come first
    are taken.  Of examples with the same words and label one teaches.
    """
    spark: SparkSession = documents.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(examples)
    texts = documents.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most `examples` ids of 12 bytes, so the ids go to the texts.
    taught = texts.join(F.broadcast(some), "_id").select(F.col("_id").cast("bigint").alias("example"), "text", "toxic")
    one = taught.mapInArrow(_whole, "example bigint, text string, toxic int, whole bigint").groupBy("whole", "toxic")
    taught = saved(one.agg(F.min(F.struct("example", "text")).alias("x")).select("x.example", "x.text", "toxic"))
    rows = taught.mapInArrow(_vectors, "example bigint, toxic int, terms array<bigint>, counts array<int>").toArrow()

    def frequency(vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
        shared = spark.sparkContext.broadcast(vocabulary)
        found = texts.select("text").mapInArrow(_frequencies(shared), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, n = np.asarray(found["term"]), np.asarray(found["n"])
        df = np.zeros(len(vocabulary))
        df[term[term >= 0]] = n[term >= 0]
        return df, int(n[term < 0].sum())

    index = _index(rows, frequency, float(np.asarray(rows["toxic"]).mean()) if rows.num_rows else 0.0)
    if rows.num_rows:
        votes = taught.mapInArrow(_votes(spark.sparkContext.broadcast(index)), "raw double, toxic int").toArrow()
        index.calibrate(np.asarray(votes["raw"]), np.asarray(votes["toxic"]))
    return index


def _scored(batches: Iterator[pa.RecordBatch], index: Index, own: bool) -> Iterator[tuple[pa.RecordBatch, list[float], list[list[int]]]]:
    place = {e: i for i, e in enumerate(index.example.tolist())} if own else {}
    for batch in W.slices(batches, "text"):
        row, term, count = _known(W.split(batch.column("text"), W.ALNUM), index.vocabulary)
        edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
        but = [place[e] for e in batch.column("example").to_pylist()] if own else [None] * batch.num_rows
        query, found = index.queries(edge, term, count), []
        for i in range(0, batch.num_rows, TEXTS):
            part = edge[i : i + TEXTS + 1]
            base = index.base(part - part[0], term[part[0] : part[-1]], query[part[0] : part[-1]])
            found += [index.raw(term[s:e], query[s:e], x, b) for s, e, x, b in zip(part[:-1], part[1:], base, but[i : i + TEXTS])]
        yield batch, [x[0] for x in found], [x[1] for x in found]


def _votes(shared):
    """The votes on each example without its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, _ in _scored(batches, shared.value, True):
            yield pa.record_batch([pa.array(raw, pa.float64()), batch.column("toxic")], names=["raw", "toxic"])

    return run


def _score(shared, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch, raw, near in _scored(batches, index, False):
            scores = index.curve(np.array(raw, float))
            yield pa.record_batch([batch.column(f) for f in fields] + [pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=[*fields, "score", "evidence"])

    return run


def score(documents: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """documents with score (0 to 1) and evidence (ids of the nearest examples, nearest first).

    A text without any of the terms, such as an empty or null one, gets what
    the curve makes of the share of toxic examples, and no evidence.  Without
    labels, and without toxic ones, the score is 0.  Columns of those names are
    replaced.
    """
    spark: SparkSession = documents.sparkSession
    rest = [c for c in documents.columns if c not in ("score", "evidence")]
    inner = [f"c{i}" for i in range(len(rest))]
    frame = documents.select(*[exact(c).alias(n) for c, n in zip(rest, inner)], F.coalesce(exact(text), F.lit("")).alias("text"))
    shape = ", ".join(f"{n} {documents.schema[c].dataType.simpleString()}" for c, n in zip(rest, inner))
    out = frame.mapInArrow(_score(spark.sparkContext.broadcast(index), inner), f"{shape}, score double, evidence array<bigint>")
    return out.withColumnsRenamed(dict(zip(inner, rest)))


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
