"""Line dedup by winnowing over line hashes (operator 1).

A document is a row of line hashes.  A window is the shortest run of lines, from
a line on or up to it, that has WORDS words or WINDOW lines; every run of so much
consists of windows.  In every window the line of least hash is selected: its
place is the fingerprint of the window.  Equal windows select the same line, so
no shared run of so much can be missed, and only selected places travel, each
with the windows that selected it.

Places of equal fingerprints are joined; those that meet another are extended
both ways to their windows, and the earliest place of each window stays, in the
order of document id, text and line.  Later ones are deleted; where they overlap
or touch they make a longer run.

Places that share a fingerprint are not paired: the earliest place of each window
is one aggregate, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as W
from .storage import saved

#: Lines of a window, and words that make fewer lines a window.
WINDOW, WORDS = 3, 20
LAST = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line of each text: the number of its text, its hash without the spaces around it, its words, and whether it is blank."""
    data, offsets = W.utf8(column)
    breaks = np.flatnonzero(data == 0x0A)
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    # A line ends a byte before the next one of its text, and the last one where its text does.
    end = np.append(start[1:] - 1, offsets[-1])
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end[: len(row)][last] = offsets[1:]
    end = end[: len(row)]
    solid = np.flatnonzero(data != 0x20)
    first, beyond = np.searchsorted(solid, start), np.searchsorted(solid, end)
    blank = first >= beyond
    hashes = np.zeros(len(start), np.uint64)
    hashes[~blank] = W.word_hashes(data, solid[first[~blank]], solid[beyond[~blank] - 1] + 1, W.BYTES)
    words = W.split(column, W.SPACED, hashed=False).start
    return row, hashes, np.searchsorted(words, end) - np.searchsorted(words, start), blank


def _selected(window: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            row, hashes, words, blank = _lines(batch.column("text"))
            first = np.searchsorted(row, np.arange(batch.num_rows))[row] if len(row) else row
            total = np.concatenate([[0], np.cumsum(words)])
            rank = np.where(blank, np.uint64(2**64 - 1), hashes)
            places, starts, sizes, labels = ([np.zeros(0, np.int64)] for _ in range(4))
            for n in range(1, min(window, len(row)) + 1):
                s = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
                enough = (total[s + n] - total[s] >= least_words) | (n == window)
                shortest = (total[s + n - 1] - total[s] < least_words) | (total[s + n] - total[s + 1] < least_words)
                real = ~np.all([blank[s + k] for k in range(n)], axis=0)
                s = s[enough & shortest & real]
                least = np.argmin([rank[s + k] for k in range(n)], axis=0) if len(s) else s
                places.append(s + least)
                starts.append(s)
                sizes.append(np.full(len(s), n))
                labels.append(W.grams(hashes, n)[s].view(np.int64))
            place, start, size, label = map(np.concatenate, (places, starts, sizes, labels))
            order = np.lexsort((start, place))
            place, start, size, label = place[order], start[order], size[order], label[order]
            heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
            own = place[heads]
            offsets = pa.array(np.append(heads, len(place)).astype(np.int32))
            inner = pa.StructArray.from_arrays([pa.array((start - first[place]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(label)], ["s", "n", "label"])
            source = pa.array(row[own])
            yield pa.record_batch([batch.column("key").take(source), batch.column("id").take(source), pa.array(hashes[own].view(np.int64)), pa.array(own - first[own]), pa.ListArray.from_arrays(offsets, inner)], names=["key", "id", "fp", "place", "windows"])

    return run


def repeated_runs(documents: DataFrame, window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """key and runs (start and end of lines, end exclusive) of the rows key, id, text that hold later repeats."""
    shape = "key bigint, id bigint, fp bigint, place bigint, windows array<struct<s:int,n:int,label:bigint>>"
    found = saved(documents.mapInArrow(_selected(window, words), shape))
    place = F.struct("id", "key", "place")
    shared = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a < z").select("fp")
    hits = found.join(shared, "fp").select("key", "id", F.explode("windows").alias("w")).select("key", "id", "w.*")
    first = hits.groupBy("label", "n").agg(F.min(F.struct("id", "key", "s")).alias("first"))
    later = hits.join(first, ["label", "n"]).where(F.struct("id", "key", "s") > F.col("first")).select("key", "s", (F.col("s") + F.col("n")).alias("e")).distinct()

    by_line = Window.partitionBy("key").orderBy("s", "e")
    new = F.coalesce(F.max("e").over(by_line.rowsBetween(Window.unboundedPreceding, -1)) < F.col("s"), F.lit(True))
    runs = later.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(by_line)).groupBy("key", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, words: int = WORDS) -> DataFrame:
    """documents with text without its later repeated runs, n_lines and n_removed.

    Lines are what stands between line feeds, compared without the spaces
    around them.  A window of blank lines only is no repeat.  Null texts stay
    null and have no lines; an empty text has one blank line.  A null id comes
    after all others.  Rows of one id but different texts are told apart by
    their texts, so one of them keeps what they share; rows alike in id and text
    keep the same lines.  Columns named like the added ones are replaced;
    others come back as they are, whatever their names.
    """
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(LAST)).alias("id"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("id", "text"))
    out = docs.drop("id").join(repeated_runs(docs.where("text is not null").select("key", "id", "text"), window, words), "key", "left")
    lines, runs = lines_of(F.col("text")), F.col("runs")

    def without(x: Column) -> Column:
        """The lines between the runs."""
        edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), x["runs"], F.array(F.struct(F.size(x["lines"]).alias("start"), F.size(x["lines"]).alias("end"))))
        return bind(edges, lambda e: F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.slice(x["lines"], F.get(e, i - 1)["end"] + 1, F.get(e, i)["start"] - F.get(e, i - 1)["end"]))), "\n"))

    n_removed = F.aggregate(runs, F.lit(0), lambda n, r: n + r["end"] - r["start"])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    kept = F.when(runs.isNull(), F.col("text")).otherwise(bind(F.struct(lines.alias("lines"), runs.alias("runs")), without))
    return out.select(*[kept.alias(c) if c == text else F.col(f"d.`{c}`") for c in own], n_lines.alias("n_lines"), F.coalesce(n_removed, F.lit(0)).cast("bigint").alias("n_removed"))
