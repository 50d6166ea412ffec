"""Near duplicates by simhash fingerprints (operator 12).

A fingerprint of 64 bits is cut into segments of two bits, and each segment
becomes its count of ones.  The Manhattan distance of two such count vectors
never exceeds the Hamming distance of the fingerprints.  The 32 counts are dealt
to three bands; of two fingerprints at most four bits apart, at least one band
has a distance of at most one.  So each band is a grid whose cells are count
vectors, and a range join of radius one finds every link: a fingerprint stands
in its own cell, and one whose counts sum up to an even number visits the
neighbours as well, for neighbours differ in parity.  Candidates are verified on
all 64 bits.

Equal fingerprints are one node.  A cell with more than OWNERS residents is cut
into slices that are joined one by one, so no task holds a cell.  Within a slice
only as many links go out as its components need, never all pairs of a group.

Null and empty texts, and texts of white space, have the fingerprint zero and are linked like any
other.  Texts of fewer words than a shingle are one shingle.  Rows that repeat a
doc_id are documents of their own; the least id that is not null names a
component.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import saved
from .words import slices

SHINGLE, APART, SEED = 4, 4, 42
#: Residents of a cell that one slice holds.
OWNERS = 4096
#: Fingerprints compared at a time.
TILE = 1 << 20

_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Segments of two bits for each band, from the lowest; a band fits base 3 in a long.
BANDS = ((0, 11), (11, 22), (22, 32))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The bits that over half of the hashes of word shingles have."""
    words = (text or b"").translate(_FOLDED).split()  # of bytes, split() takes just the white space of ASCII
    if not words:
        return 0
    own = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size))))
    counts, n, part = np.zeros(64, np.int64), 0, []

    def add() -> None:
        nonlocal n
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        counts[:] += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
        part.clear()

    for shingle in own:
        part.append(xxhash.xxh64_digest(shingle, SEED))  # most significant byte first
        if len(part) == 1 << 15:
            add()
    if part:
        add()
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(documents: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(x, size) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    own = documents.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp bigint")


def counts(fp: np.ndarray) -> np.ndarray:
    """For each fingerprint the ones in each of its 32 segments."""
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_count((fp[:, None] >> shifts) & np.uint64(3))


def cells(classes: DataFrame) -> DataFrame:
    """cell, guest, fp: a fingerprint in its own cell of each band, and as a guest in the neighbours if its band's counts sum up to an even number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            own = counts(fp).astype(np.int64)
            for band, (low, high) in enumerate(BANDS):
                scale = 3 ** np.arange(high - low, dtype=np.int64)
                part = own[:, low:high]
                home = part @ scale
                yield _placed(band, home, np.zeros(len(fp), bool), fp)
                even = part.sum(axis=1) % 2 == 0
                for i in range(high - low):
                    for step in (-1, 1):
                        goes = even & (part[:, i] + step >= 0) & (part[:, i] + step <= 2)
                        yield _placed(band, home[goes] + step * scale[i], np.ones(goes.sum(), bool), fp[goes])

    return classes.select("fp").mapInArrow(run, "cell bigint, guest boolean, fp bigint")


def _placed(band: int, cell: np.ndarray, guest: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(cell * len(BANDS) + band), pa.array(guest), pa.array(fp.view(np.int64))], names=["cell", "guest", "fp"])


def _near(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= apart


def grouped(fp: np.ndarray, apart: int = APART) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A label for each fingerprint, and links that connect those of a label.

    Whoever is reached leaves the rest at once, so members of a group aren't compared with each other again.
    """
    label, links = np.arange(len(fp)), []
    step = max(1, TILE // max(1, len(fp)))
    touched = np.concatenate([_near(fp[i : i + step], fp, apart).sum(axis=1) > 1 for i in range(0, len(fp), step)]) if len(fp) else np.zeros(0, bool)
    rest = np.flatnonzero(touched)
    while len(rest):
        first, rest = rest[0], rest[1:]
        frontier = [first]
        while frontier and len(rest):
            now = frontier.pop()
            hit = np.bitwise_count(fp[rest] ^ fp[now]) <= apart
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                label[found] = first
                links += [(int(now), int(i)) for i in found]
                frontier += found.tolist()
    return label, links


def _joined(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """Links of slices: rows come by cell and slice, owners first, then the others."""
    key, owners, closed = None, [], False
    own, label = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal own, label, closed
        own, closed = np.concatenate(owners) if owners else np.zeros(0, np.uint64), True
        label, links = grouped(own, apart)
        if links:
            a, b = np.array(links).T
            yield out(own[a], own[b])

    def visit(guests: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE // max(1, len(own)))
        for i in range(0, len(guests) if len(own) else 0, step):
            row, column = np.nonzero(_near(guests[i : i + step], own, apart))
            if len(row):
                _, once = np.unique(row * len(own) + label[column], return_index=True)  # one link to each group
                yield out(guests[i : i + step][row[once]], own[column[once]])

    for batch in batches:
        cell, part, guest, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "guest", "fp"))
        fp = fp.view(np.uint64)
        edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (guest[1:] != guest[:-1]), [True]])) if len(fp) else np.zeros(0, int)
        for i, j in zip(edges[:-1], edges[1:]):
            if (cell[i], part[i]) != key:
                if not closed and owners:
                    yield from close()
                key, owners, closed = (cell[i], part[i]), [], False
            if guest[i]:
                if not closed:
                    yield from close()
                yield from visit(fp[i:j])
            else:
                owners.append(fp[i:j])
    if not closed and owners:
        yield from close()


def links(classes: DataFrame, apart: int = APART, owners: int = OWNERS) -> DataFrame:
    """u, v: fingerprints (column fp, each once) at most apart bits apart, enough to connect their components; apart is 4 at most."""
    if not 0 <= apart <= 4:
        raise ValueError("three bands of radius one hold for at most 4 bits")
    placed = cells(classes)
    # At most 3^11 + 3^11 + 3^10 cells, whatever the table.
    sizes = placed.where("not guest").groupBy("cell").agg(F.ceil(F.count("*") / owners).cast("int").alias("parts"))
    cut = placed.join(F.broadcast(sizes), "cell")  # a cell without residents has nothing to visit
    home = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # A resident owns one slice and visits those after it; a guest visits all.
    spread = cut.withColumn("part", F.explode(F.sequence(F.when(F.col("guest"), F.lit(0)).otherwise(home), F.col("parts") - 1)))
    spread = spread.select("cell", "part", (F.col("guest") | (F.col("part") > home)).alias("guest"), "fp")
    dealt = spread.repartition("cell", "part").sortWithinPartitions("cell", "part", "guest")
    return dealt.mapInArrow(lambda batches: _joined(batches, apart), "u bigint, v bigint")


def near_duplicates(documents: DataFrame, text: str = "text", id: str = "doc_id", size: int = SHINGLE, apart: int = APART) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id that links lead to."""
    docs = saved(fingerprints(documents, text, id, size))
    classes = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(classes, apart))
    named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # Components of one node need no second look.
    several = named.join(groups.select("component").distinct(), "component", "left_semi")
    least = several.groupBy("component").agg(F.min("least").alias("over"))
    ids = named.join(least, "component", "left").select("fp", F.coalesce("over", "least").alias("component_id"))
    # A fingerprint that many documents share is cut by the skew join.
    found = docs.join(ids, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
