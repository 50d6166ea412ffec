"""Alignment of two tokenizers over the same bytes (operator 13).

Both encodings of a text end at byte offsets.  The union of both lists of ends
cuts the text into elementary intervals; looking up an interval's end in each
list gives its owners, one token of either side, and so each interval is one
overlap.  Ends that both lists share close groups, and within a group every
token of one side is linked with every token of the other.

How many documents hold a pair of ids linked is counted on Spark.  Texts are
encoded once: what a document holds is written as its distinct pairs with how
often each occurs, in blocks of bounded size.  Pairs with at least 1 / HEAVY of
all (document, pair) rows are HEAVY at most, whatever the corpus, and are
broadcast; all others are joined by a shuffle, so no frequent pair meets in one
task.  The best count of an id is one number for each id of the vocabulary.

Null and empty texts, and those whose tokens don't give back their bytes, have
no tokens.  Each row is a document of its own, repeated ids included.  An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved, written
from .words import slices

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs that are broadcast, at most.
HEAVY = 1 << 16
#: Linked pairs that a task expands at a time.
BLOCK = 1 << 21
#: Bytes of text encoded at a time, words whose encodings a worker remembers, and the longest of them.
TEXTS, KNOWN, LONG = 1 << 20, 1 << 19, 48
# Characters that are surely no white space: printable ASCII, and letters of common scripts.
SOLID = "!-~À-ɏͰ-ԯぁ-ヿ一-鿿가-힣"
#: A space that begins a word after another word, and what has such characters at both ends; words encoded together.
BETWEEN, WORD, TOGETHER = re.compile(f"(?<=[{SOLID}]) (?=[{SOLID}])"), re.compile(f"[{SOLID}](?:.*[{SOLID}])?\\Z", re.S), 2048


class Side:
    """One tokenizer: ids of texts, and the bytes of each id; by_words says that no token ever spans a space BETWEEN words."""

    def __init__(self, pieces: list[bytes], by_words: bool):
        self.pieces, self.by_words = pieces, by_words
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class ByteLevel(Side):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        by_id = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        # Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
        pieces = [bytes(byte[c] for c in by_id[i]) if i in by_id and all(c in byte for c in by_id[i]) else b"" for i in range(max(by_id) + 1)]
        parts = json.loads(self.model.to_str())
        cut = parts["pre_tokenizer"] or {}
        # The pattern of byte-level vocabularies takes a space along with the word after it.
        super().__init__(pieces, parts["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # Merges never cross a space where no piece has one after another character, and texts are taken as they are.
        plain = self.model.normalize("ﬁ  Å x ") == "▁ﬁ▁▁Å▁x▁"
        super().__init__(pieces, plain and not any(re.search("[^▁]▁", p) for p in names))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def _side(path: str) -> Side:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


@dataclass
class Encoded:
    """Texts one after another: ids of either side, how many each text has, and whether both give back its bytes after a space."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    same: np.ndarray

    def good(self) -> Encoded:
        """Without the tokens of texts that don't come back."""
        if self.same.all():
            return self
        n_a, n_b = self.n_a * self.same, self.n_b * self.same
        return Encoded(self.a[np.repeat(self.same, self.n_a)], self.b[np.repeat(self.same, self.n_b)], n_a, n_b, self.same)


class Both:
    """Two tokenizers over the same texts.  Where both go word by word, a word is encoded once and remembered.

    What is known of a word is 32-bit numbers: twice its tokens of a, plus 1 if it comes back; then its ids of a and of b.
    """

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.known = a, b, {}
        self.by_words = a.by_words and b.by_words

    def _packed(self, text: bytes, x: list[int], y: list[int]) -> bytes:
        same = self.a.bytes_of(x) == b" " + text == self.b.bytes_of(y)
        return array("I", [2 * len(x) + same, *x, *y]).tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [self._packed(t.encode(), x, y) for t, x, y in zip(texts, self.a.encode(texts), self.b.encode(texts))]

    def _learn(self, words: list[str]) -> None:
        """Words that begin and end like words are encoded as a text of them all."""
        whole = list(filter(WORD.match, words))
        rest = list(set(words).difference(whole)) if len(whole) < len(words) else []
        for i in range(0, len(whole), TOGETHER):
            part = whole[i : i + TOGETHER]
            text = " ".join(part)
            raw = b" " + text.encode()
            x, y = self.a.encode([text])[0], self.b.encode([text])[0]
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            ids_a, ids_b = np.array(x, dtype=np.uint32), np.array(y, dtype=np.uint32)
            ends_a, ends_b = np.cumsum(self.a.lengths[x]), np.cumsum(self.b.lengths[y])
            cut_a, cut_b = np.append(0, np.searchsorted(ends_a, ends) + 1), np.append(0, np.searchsorted(ends_b, ends) + 1)
            if self.a.bytes_of(x) != raw or self.b.bytes_of(y) != raw or (ends_a[cut_a[1:] - 1] != ends).any() or (ends_b[cut_b[1:] - 1] != ends).any():
                rest += part
                continue
            n_a, n_b = np.diff(cut_a), np.diff(cut_b)
            size = 1 + n_a + n_b
            start = np.cumsum(size) - size
            flat = np.empty(int(size.sum()), np.uint32)
            flat[start] = 2 * n_a + 1
            flat[np.repeat(start + 1 - cut_a[:-1], n_a) + np.arange(len(ids_a))] = ids_a
            flat[np.repeat(start + 1 + n_a - cut_b[:-1], n_b) + np.arange(len(ids_b))] = ids_b
            held, edges = flat.tobytes(), np.append(start, len(flat)) * 4
            self.known.update((w, held[f:t]) for w, f, t in zip(part, edges[:-1].tolist(), edges[1:].tolist()))
        self.known.update(zip(rest, self._each(rest)))

    def encode(self, texts: list[str]) -> Encoded:
        if self.by_words:
            words = [BETWEEN.split(t) for t in texts]
            if len(self.known) > KNOWN:
                self.known.clear()
            new = list({w for own in words for w in own}.difference(self.known))
            self._learn(new)
            values, first = [self.known[w] for own in words for w in own], np.cumsum([0, *map(len, words)])[:-1]
            for w in new:
                if len(w) > LONG:
                    del self.known[w]
        else:
            values, first = self._each(texts), np.arange(len(texts))
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), np.uint32)
        start = np.cumsum(size) - size
        head = flat[start].astype(np.int64)
        place, n_a = np.arange(len(flat)) - np.repeat(start, size), head // 2
        of_a = np.repeat(n_a, size)
        a, b = flat[(place > 0) & (place <= of_a)].astype(np.int64), flat[place > of_a].astype(np.int64)
        found = Encoded(a, b, np.add.reduceat(n_a, first), np.add.reduceat(size - 1 - n_a, first), np.logical_and.reduceat(head % 2 == 1, first))
        end_a, end_b = np.cumsum(found.n_a), np.cumsum(found.n_b)
        for i in np.flatnonzero(~found.same):  # a word doesn't come back: the whole text decides
            whole = b" " + texts[i].encode()
            found.same[i] = all(side.bytes_of(ids[end[i] - n[i] : end[i]].tolist()) == whole for side, ids, end, n in ((self.a, a, end_a, found.n_a), (self.b, b, end_b, found.n_b)))
        return found


@cache
def _both(byte_bpe: str, piece_bpe: str) -> Both:
    """The tokenizers of two files, once for each worker; the paths are ones that executors can read."""
    return Both(_side(byte_bpe), _side(piece_bpe))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elementary intervals' ends, and for each its token of either side."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of either side the number of its group; both lists end at the same offset."""
    ends, a, b = overlaps(ends_a, ends_b)
    closes = (ends_a[a] == ends) & (ends_b[b] == ends)
    of_interval = np.cumsum(closes) - closes
    # A token lies in one group, so its last interval says which.
    last = lambda owner, n: of_interval[np.searchsorted(owner, np.arange(n), side="right") - 1]
    return last(a, len(ends_a)), last(b, len(ends_b))


def pairs(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct linked pairs, a << 32 | b in order, and how often each is linked; about block at a time.

    An id counts once in a group, with its occurrences as a factor, so one id of
    a makes at most as many rows as b has tokens; blocks end between ids of a.
    """
    n = int(group_a[-1]) + 1
    key_a, times_a = np.unique(a * n + group_a, return_counts=True)
    key_b, times_b = np.unique(group_b * (1 << 32) + b, return_counts=True)
    own_a, own_group = key_a // n, key_a % n
    first = np.searchsorted(key_b, np.arange(n + 1) * (1 << 32))
    sizes = np.diff(first)[own_group]
    done, i = np.cumsum(sizes), 0
    while i < len(own_a):
        j = int(np.searchsorted(done, (done[i - 1] if i else 0) + block, side="right"))
        j = int(np.searchsorted(own_a, own_a[min(j, len(own_a) - 1)], side="left")) if j < len(own_a) else j
        if j <= i:  # one id alone
            j = int(np.searchsorted(own_a, own_a[i], side="right"))
        size = sizes[i:j]
        start = np.repeat(first[own_group[i:j]] - (np.cumsum(size) - size), size)
        at = start + np.arange(len(start))
        key = np.repeat(own_a[i:j] << 32, size) | (key_b[at] & 0xFFFFFFFF)
        weight = np.repeat(times_a[i:j], size) * times_b[at]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[heads], np.add.reduceat(weight, heads)
        i = j


def _tables(n_a: int, n_b: int) -> np.ndarray:
    """Ids as text before a comma or at the end of a side: a, then a|, then b, then b; as one list."""
    ids_a, ids_b = [str(i) for i in range(n_a)], [str(i) for i in range(n_b)]
    return np.array([i + "," for i in ids_a] + [i + "|" for i in ids_a] + [i + "," for i in ids_b] + [i + ";" for i in ids_b], dtype=object)


def _spelling(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """The groups as a1,a2|b1;a3|b2,b3: places in the list of _tables."""
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    out = np.empty(len(a) + len(b), np.int64)
    # Before a token stand the groups before its own, and on the side b its group's tokens of a.
    out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + n_a * last_a
    out[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = 2 * n_a + b + n_b * last_b
    return out


FIELDS = "doc_id place n_a n_b n_groups n_links groups_sha256 pairs times".split()


def aligned(documents: DataFrame, text: str = "text", id: str = "doc_id", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECES, block: int = BLOCK) -> DataFrame:
    """A row of FIELDS for each document, and for further blocks of its pairs rows of the same place without counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(byte_bpe, piece_bpe)
        side_a, side_b = both.a, both.b
        n_a, n_b = len(side_a.pieces), len(side_b.pieces)
        table = _tables(n_a, n_b)
        for batch in slices(batches, "text", TEXTS):
            texts = batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            rows: list[tuple] = [(i, 0, 0, 0, 0, "", None, None) for i, t in enumerate(texts) if not t]
            if some:
                found = both.encode([texts[i] for i in some])
                rows += [(i, 0, 0, 0, 0, "", None, None) for i, same in zip(some, found.same) if not same]
                found, held = found.good(), 0
                a, b = found.a, found.b
                if len(a):
                    # Texts one after another: their ends are shared by both sides, so no group crosses one.
                    group_a, group_b = groups(np.cumsum(side_a.lengths[a]), np.cumsum(side_b.lengths[b]))
                    spelled = table[_spelling(a, b, group_a, group_b, n_a, n_b)]
                    links = np.append(0, np.cumsum(np.bincount(group_a) * np.bincount(group_b)))
                ends = zip(np.cumsum(found.n_a).tolist(), np.cumsum(found.n_b).tolist(), found.n_a.tolist(), found.n_b.tolist())
                for i, (to_a, to_b, x, y) in zip(some, ends):
                    if not x:
                        continue
                    at_a, at_b = to_a - x, to_b - y
                    first, last = int(group_a[at_a]), int(group_a[to_a - 1]) + 1
                    digest = hashlib.sha256("".join(spelled[at_a + at_b : to_a + to_b].tolist())[:-1].encode()).hexdigest()
                    head = (x, y, last - first, int(links[last] - links[first]), digest)
                    for keys, times in pairs(a[at_a:to_a], b[at_b:to_b], group_a[at_a:to_a] - first, group_b[at_b:to_b] - first, block):
                        rows.append((i, *head, keys, times))
                        head, held = (None,) * 5, held + len(keys)
                        if held >= block:
                            yield _batch(batch, rows)
                            rows, held = [], 0
            if rows:
                yield _batch(batch, rows)

    own = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("place"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, place bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def _batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    at, *rest = zip(*rows)
    numbers = [pa.array(c, pa.int64()) for c in rest[:4]]
    lists = [pa.array(c, pa.list_(pa.int64())) for c in rest[5:]]
    keys = [batch.column(c).take(pa.array(at)) for c in ("doc_id", "place")]
    return pa.record_batch([*keys, *numbers, pa.array(rest[4], pa.string()), *lists], names=FIELDS)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of its first id has more); found has pairs, each once a document."""
    counted = saved(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    # A row for each id of the first vocabulary.
    top = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    return counted.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(documents: DataFrame, text: str = "text", id: str = "doc_id", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECES, heavy: int = HEAVY, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document.

    n_best counts the links whose pair no other pair of its first id exceeds,
    count_sum adds up the counts of the pairs over all links.
    """
    # Each document has its own place, which stays as it is once written.
    found = written(aligned(documents, text, id, byte_bpe, piece_bpe, block))
    counts = saved(pair_counts(found))
    all_rows = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") >= max(1, -(-all_rows // heavy))
    each = found.select("place", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    top, rest = counts.where(frequent), counts.where(~frequent)
    near = each.join(F.broadcast(top), "pair").groupBy("place").agg(*sums)
    light = each.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(rest, "pair").groupBy("place").agg(*sums)
    both = near.union(light).groupBy("place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return found.drop("pairs", "times").where("n_a is not null").join(both, "place", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
