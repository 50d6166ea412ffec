"""Benchmark decontamination by winnowing (operator 3).

Both sides are cut into overlapping k-grams of words; in every window of w
consecutive k-grams the one of least hash is kept as a fingerprint.  A span of
k + w - 1 = WINDOW words that both sides share holds the same window of
k-grams on both sides, so it yields the same fingerprint on both sides: no
shared span of WINDOW words can be missed.  Fingerprints that meet are hits;
a hit is extended word by word, and counts where WINDOW words agree.

The benchmark is the side that is small by nature.  It is broadcast in blocks of
at most BLOCK_WORDS words; one block is one narrow pass over the documents,
without a shuffle.  A larger benchmark takes a pass for each block, whose hits
are written before the next block is read, so one block is in memory at a time.

A window that many items or many places of a document share is one row of a
block with the list of its items: places and items are not paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W
from .storage import exact, saved

#: Words of a window, and of a k-gram; w follows.
WINDOW, GRAM = 10, 5
#: Most benchmark words in one broadcast; a word takes about 30 bytes there.
BLOCK_WORDS = 4_000_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def winnow(words: W.Words, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of each text."""
    found = W.grams(words.hash, k)
    least = W.window_minimum(found, window - k + 1)
    least = np.unique(least[W.inside_text(words, window)])
    return least, found[least]


class Block:
    """Fingerprints and windows of some benchmark items, each once, with the items of each window."""

    def __init__(self, ids: list[str | None], column: pa.Array):
        words = W.split(column, W.ALNUM)
        self.ids = ids
        self.fp = np.unique(winnow(words)[1])
        start = np.flatnonzero(W.inside_text(words, WINDOW))
        found = {WINDOW: (W.grams(words.hash, WINDOW)[start], np.searchsorted(words.first, start, side="right") - 1)}
        for n in range(1, WINDOW):
            items = np.flatnonzero(words.count == n)
            if len(items):
                found[n] = (W.grams(words.hash, n)[words.first[items]], items)
        #: By length of window: the hashes, where the items of each begin, and the items.
        self.windows = {}
        for n, (value, item) in found.items():
            pair = np.unique(np.stack([value, item.astype(np.uint64)], axis=1), axis=0)
            value, first = np.unique(pair[:, 0], return_index=True)
            self.windows[n] = (value, np.append(first, len(pair)), pair[:, 1].astype(np.int64))


def _among(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def _occurrences(words: W.Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, length and number of every window of the block that occurs in a text."""
    out = []
    for n, (table, _, _) in block.windows.items():
        inside = W.inside_text(words, n)
        if n == WINDOW:
            at, fp = winnow(words)
            met = at[_among(fp, block.fp)[0]]
            start = np.unique(met[:, None] + np.arange(GRAM - WINDOW, 1))
            start = start[(start >= 0) & (start < len(inside))]
        else:
            start = np.arange(len(inside))
        start = start[inside[start]]
        hit, number = _among(W.grams(words.hash, n)[start], table)
        out.append((start[hit], start[hit] + n, np.full(hit.sum(), n), number[hit]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _found(column: pa.Array, block: Block) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words of each text, its merged hits and the items they are of."""
    words = W.split(column, W.ALNUM)
    spans: list[list] = [[] for _ in range(len(column))]
    items: list[set] = [set() for _ in range(len(column))]
    start, end, length, number = _occurrences(words, block)
    doc = np.searchsorted(words.first, start, side="right") - 1
    for d, s, e in zip(doc.tolist(), (start - words.first[doc]).tolist(), (end - words.first[doc]).tolist()):
        spans[d].append((s, e))
    for d, n, k in np.unique(np.stack([doc, length, number], axis=1), axis=0).tolist():
        _, first, item = block.windows[n]
        items[d].update(item[first[k] : first[k + 1]].tolist())
    names = [sorted({block.ids[k] for k in x if block.ids[k] is not None}) for x in items]
    return words.count, [_merge(x) for x in spans], names


def _pass(shared, text: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, text):
            count, spans, items = _found(batch.column(text), shared.value)
            made = {
                "n_words": pa.array(count, pa.int64()),
                "hit_spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], schema.field("hit_spans").type),
                "hit_items": pa.array(items, schema.field("hit_items").type),
            }
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return run


def _hits(shared):
    """Spans and items of the texts that have any, by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in W.slices(batches, "text"):
            _, spans, items = _found(batch.column("text"), shared.value)
            some = [i for i, x in enumerate(spans) if x]
            spans = pa.array([[{"start": s, "end": e} for s, e in spans[i]] for i in some], kind)
            yield pa.record_batch([batch.column("key").take(pa.array(some, pa.int64())), spans, pa.array([items[i] for i in some], pa.list_(pa.string()))], names=["key", "spans", "items"])

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, one in memory at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        n = len(row.t) // 2 + 1
        if ids and size + n > block_words:
            yield Block(ids, pa.array(texts, pa.large_string()))
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        size += n
    yield Block(ids, pa.array(texts, pa.large_string()))


def find_contamination(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents with n_words, hit_spans (word ranges, end exclusive) and hit_items.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. A
    null or empty text has no words and no hits.  An item of fewer than WINDOW
    words is one window; an item without words matches nothing; an item whose
    id is null marks words but is not listed.  Repeated rows are judged each.
    Columns of documents named like the added ones are replaced.
    """
    spark: SparkSession = documents.sparkSession
    documents = documents.drop(*[f.name for f in ADDED])
    names = {f"c{i}": c for i, c in enumerate(documents.columns)}
    inner = {c: n for n, c in names.items()}
    documents, text = documents.select(*[exact(c).alias(n) for n, c in names.items()]), inner[text]
    kept = T.StructType([f for f in documents.schema.fields] + ADDED)
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    first = next(blocks)
    out = documents.mapInArrow(_pass(spark.sparkContext.broadcast(first), text, to_arrow_schema(kept)), kept)
    more, key = [], F.xxhash64(text)
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)
        texts = documents.select(key.alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        more.append(saved(texts.mapInArrow(_hits(shared), "key bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>").dropDuplicates(["key"])))
        shared.destroy()
    if not more:
        return out.withColumnsRenamed(names)
    # Equal texts have equal hits, so a text stands for all rows that have it.
    found = reduce(DataFrame.union, more).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    out = out.select(F.struct(*documents.columns).alias("d"), key.alias("key"), *[f.name for f in ADDED]).join(found, "key", "left")
    none = F.array().cast(SPANS)
    spans = F.array_sort(F.concat("hit_spans", F.coalesce("spans", none)))

    def add(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = F.when(F.size(done) > 0, x["start"] <= last["end"]).otherwise(False)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    items = F.array_sort(F.array_union("hit_items", F.coalesce("items", F.array().cast("array<string>"))))
    return out.select("d.*", "n_words", F.aggregate(spans, none, add).alias("hit_spans"), items.alias("hit_items")).withColumnsRenamed(names)


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window, with their own columns."""
    found = find_contamination(documents, benchmark, **options)
    return found.where(F.size("hit_spans") == 0).select(*[exact(c) for c in documents.columns])
