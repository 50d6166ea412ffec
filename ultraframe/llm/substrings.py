"""Substring dedup by the deep nodes of suffix trees, without the trees (operator 9).

A passage is removed where WINDOW consecutive words of a document also start
in a document of smaller id.  Such passages are the internal nodes of depth
WINDOW or more in the suffix tree of all documents.  Only the nodes at that depth
are needed, so suffixes are cut there and their labels are compared by hash:

1. Every window of WINDOW words is filed under a short prefix, the PREFIX
   words that have the least hash of all in the window.  Equal windows choose
   equal prefixes, and neighbouring windows mostly share one, so there are
   about five times fewer prefixes than windows.  A prefix that only one
   document holds leads to no internal node; those are dropped.
2. Where a prefix is shared it is lengthened to the whole window, and windows
   are dealt out by that to groups of bounded size, so a prefix that very many
   documents go on from is many groups.  In a group the labels are sorted; a run
   of one label is an internal node, and its leaves beyond the smallest document
   are repeats.

Overlapping repeated windows join to maximal repeats when the words are marked.

What many documents share is gathered before it is dealt out: each task keeps
the smallest document for a prefix or label and decides about its own other
ones by itself, so a passage in a third of all documents is a row for each
task.  A document's text is shuffled once, to meet the positions found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W

WINDOW, PREFIX = 13, 5
#: Characters of text for each group, and bytes of text that a task gathers over.
GROUP_CHARS, CHUNK = 16_000_000, 1 << 23
LAST = np.iinfo(np.int64).max
ENTRY = np.dtype([("label", "<u8"), ("id", "<i8"), ("key", "<i8"), ("at", "<u4")])
ANYWHERE = 0xFFFFFFFF
PLACE = np.dtype([("key", "<i8"), ("at", "<u4")])
PARTS = pa.schema([("bucket", pa.int32()), ("found", pa.bool_()), ("data", pa.binary())])


def _pack(rows: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in rows.dtype.names))


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for name in kind.names:
        out[name] = np.frombuffer(raw, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


def _dealt(rows: np.ndarray, by: np.ndarray, buckets: int, found: bool) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket."""
    if not len(rows):
        return
    bucket = (by.astype(np.uint64) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(heads[1:], len(bucket))
    yield pa.record_batch([pa.array(bucket[heads]), pa.array([found] * len(heads)), pa.array([_pack(rows[s:e]) for s, e in zip(heads, ends)], pa.binary())], schema=PARTS)


def _positions(key: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Positions found, on their way to the documents."""
    order = np.lexsort((at, key))
    rows = np.empty(len(key), PLACE)
    rows["key"], rows["at"] = key[order], at[order]
    yield from _dealt(rows, W.mix(rows["key"].view(np.uint64)), buckets, True)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document with all positions found in it."""
    rows = [_unpack(x, PLACE) for batch in batches for x in batch.column("data").to_pylist()]
    if rows:
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows["at"], rows["key"]))]
        key, at = rows["key"], np.ascontiguousarray(rows["at"])
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for i in range(0, len(heads), 10_000):
            own = heads[i : i + 10_001]
            ends = np.append(own[1:], len(key)) if len(own) <= 10_000 else own[1:]
            own = own[: len(ends)]
            yield pa.record_batch([pa.array(key[own]), pa.array([at[s:e].tobytes() for s, e in zip(own, ends)], pa.binary())], names=["key", "parts"])


def _rows(words: W.Words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and keys of the rows, and which rows are the first of their key."""
    key = np.asarray(batch.column("key"))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return np.asarray(batch.column("id")), key, first


def _anchors(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, the word where each one's prefix is, and all prefix hashes."""
    found = W.grams(words.hash, PREFIX)
    least = W.window_minimum(found, WINDOW - PREFIX + 1)
    start = np.flatnonzero(W.inside_text(words, WINDOW))
    return start, least[start], found


def _find_prefixes(buckets: int):
    """Prefixes of each text; those that two texts of one chunk share are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", CHUNK):
            words = W.split(batch.column("text"), W.SPACED)
            ids, keys, first = _rows(words, batch)
            _, at, found = _anchors(words)
            at = np.unique(at)
            row = np.searchsorted(words.first, at, side="right") - 1
            at, row = at[first[row]], row[first[row]]
            entries = np.empty(len(at), ENTRY)
            entries["label"], entries["id"], entries["key"], entries["at"] = found[at], ids[row], keys[row], at - words.first[row]
            order, heads = W.groups(entries["label"], entries["id"])
            sizes = np.diff(np.append(heads, len(order)))
            by_label = entries[order]
            shared = by_label["id"][heads] != by_label["id"][heads + sizes - 1] if len(heads) else np.zeros(0, bool)
            member = np.repeat(shared, sizes)
            yield from _positions(by_label["key"][member], by_label["at"][member], buckets)
            known = by_label[heads[shared]]
            known["at"] = ANYWHERE
            alone = np.sort(order[~member])
            yield from _dealt(np.concatenate([entries[alone], known]), np.concatenate([entries["label"][alone], known["label"]]), buckets, False)

    return run


def _gather(batches: Iterator[pa.RecordBatch], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Unpacks entries into found; rows with positions go on as they are."""
    for batch in batches:
        known = batch.filter(batch.column("found"))
        if known.num_rows:
            yield known
        found += [_unpack(x, ENTRY) for x in batch.filter(pc.invert(batch.column("found"))).column("data").to_pylist()]


def _shared_prefixes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        yield from _gather(batches, found)
        if found:
            entries = np.concatenate(found)
            found.clear()
            order, heads = W.groups(entries["label"], entries["id"])
            entries = entries[order]
            last = np.append(heads[1:], len(entries)) - 1
            shared = (entries["id"][heads] != entries["id"][last]) | (np.maximum.reduceat(entries["at"], heads) == ANYWHERE)
            keep = np.repeat(shared, last - heads + 1) & (entries["at"] != ANYWHERE)
            yield from _positions(entries["key"][keep], entries["at"][keep], buckets)

    return run


def _numbers(parts) -> np.ndarray:
    return np.unique(np.frombuffer(parts, "<u4")).astype(np.int64)


def _find_labels(buckets: int):
    """Windows whose prefix is shared; in a chunk only the smallest document of a label goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text", CHUNK):
            batch = batch.filter(batch.column("parts").is_valid())
            if not batch.num_rows:
                continue
            words = W.split(batch.column("text"), W.SPACED)
            ids, keys, first = _rows(words, batch)
            shared = np.zeros(len(words.start) + 1, bool)
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                if first[i]:
                    shared[_numbers(parts) + words.first[i]] = True
            start, at, found = _anchors(words)
            start, at = start[shared[at]], at[shared[at]]
            row = np.searchsorted(words.first, start, side="right") - 1
            entries = np.empty(len(start), ENTRY)
            labels = W.grams(words.hash, WINDOW)
            entries["label"], entries["id"], entries["key"], entries["at"] = labels[start], ids[row], keys[row], start - words.first[row]
            order, heads = W.groups(entries["label"], entries["id"])
            least = np.repeat(entries["id"][order][heads], np.diff(np.append(heads, len(order))))
            later = np.zeros(len(order), bool)
            later[order] = entries["id"][order] > least
            yield from _positions(entries["key"][later], entries["at"][later], buckets)
            yield from _dealt(entries[~later], entries["label"][~later], buckets, False)

    return run


def _repeats(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        yield from _gather(batches, found)
        if found:
            entries = np.concatenate(found)
            found.clear()
            order, heads = W.groups(entries["label"], entries["id"])
            entries = entries[order]
            least = np.repeat(entries["id"][heads], np.diff(np.append(heads, len(entries))))
            later = entries["id"] > least
            yield from _positions(entries["key"][later], entries["at"][later], buckets)

    return run


def _kept(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            words = W.split(batch.column("text"), W.SPACED, hashed=False)
            raw = words.data.tobytes()
            start, end, first = words.start.tolist(), words.end.tolist(), words.first.tolist()
            removed, text = [], []
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                own = range(first[i], first[i + 1])
                if parts:
                    edge = np.zeros(len(own) + 1, np.int64)
                    at = _numbers(parts)
                    edge[at] += 1
                    np.subtract.at(edge, at + WINDOW, 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    own = (np.flatnonzero(~gone) + first[i]).tolist()
                else:
                    removed.append(0)
                text.append(b" ".join([raw[start[j] : end[j]] for j in own]))
            made = {"n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(text, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    return run


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space).

    Words are runs without ASCII white space.  Null and empty texts have no
    words.  A null id counts as larger than all others.  Rows with equal id
    never remove words of each other; each row is judged and returned.
    """
    docs = documents.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(int(LAST))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("id", "text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, chars // GROUP_CHARS)
    parts = "bucket int, found boolean, data binary"

    def round_trip(source: DataFrame, give, take) -> DataFrame:
        sent = source.mapInArrow(give(buckets), parts)
        found = sent.repartitionById(buckets, "bucket").mapInArrow(take(buckets), parts)
        return found.repartitionById(buckets, "bucket").mapInArrow(_by_document, "key bigint, parts binary")

    prefixes = round_trip(docs, _find_prefixes, _shared_prefixes)
    labels = round_trip(docs.join(prefixes, "key", "left"), _find_labels, _repeats)
    # The same rows of docs as in the join before, so their shuffle is used again.
    made = "id bigint, n_words bigint, n_removed bigint, kept_text string"
    shape = to_arrow_schema(documents.sparkSession.createDataFrame([], made).schema)
    out = docs.join(labels, "key", "left").mapInArrow(_kept(shape), made)
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(doc_id), "n_words", "n_removed", "kept_text")
