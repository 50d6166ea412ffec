"""Personal data: fixed patterns, then bootstrapped contextual extraction (operator 2).

The fixed patterns find e-mail addresses, IP addresses, card and phone numbers.
They are the seeds.  What stands around a seed are its lexical patterns: the two
words before it, the two after it, one on each side, and the word before it with
the shape of the seed itself.  Whatever has the form of an identifier and stands
in a pattern is an instance of it.  Patterns and instances are a bipartite graph,
scored on Spark by turns: a pattern is as good as the mean score of its
instances, drawn to 0 when it has few; instances of good patterns are as good as
these make them together, and by the other patterns they stand in they induce new
ones in the next turn.  In the end instances of trusted patterns are spans of
their kind, though no fixed pattern sees them.

Documents are read once: their fixed spans and candidates are written, patterns
are learnt from those, and joined to them.  Nothing is collected on the driver.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import saved

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, the score a pattern needs, instances that it needs, and what counts against few.
ROUNDS, ACCEPT, LEAST, DOUBT = 4, 0.8, 4, 1.0
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: numbers in groups, or a token with a digit or @.
CANDIDATE = re.compile(r"\+?\(?[0-9][0-9()./-]*(?:\x20\(?[0-9][0-9()./-]*)+(?![^\s,.;:!?)])|[^\x00-\x20]*[0-9@][^\x00-\x20]*")
WORD = re.compile(r"[^\x00-\x20]+")
EDGES = ".,;:!?()[]{}<>\"'*#$%&|"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ascii_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Matches of EMAIL; each is looked for from its @, as no match holds two."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield ("email", found.start(), found.end())
            low = found.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as in KINDS, then by start."""
    out = list(_emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _ascii_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_ascii_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """A token with each run of letters as a, and each run of digits as 0 and its length from 5 on."""
    token = re.sub(r"[0-9]+", lambda m: "0" if len(m[0]) < 5 else f"0{len(m[0])}", re.sub(r"[^\W\d_]+", "a", token))
    return token if len(token) <= 64 else token[:64] + "+"


def _plain(word: str) -> str:
    word = re.sub(r"[0-9]", "0", word.lower()).strip(EDGES)
    return word if len(word) <= 64 else word[:64] + "+"


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Places that may be identifiers and touch no span of `taken`, without punctuation around them."""
    taken = sorted((s, e) for _, s, e in taken)
    i = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if end - start >= 4 and not (i < len(taken) and taken[i][0] < end):
            yield start, end


def patterns_of(text: str, words: tuple[list[int], list[int]], start: int, end: int) -> list[str]:
    """The lexical patterns around a place; words are the starts and ends of all words of the text."""
    starts, ends = words
    first, last = bisect.bisect_right(starts, start) - 1, bisect.bisect_left(ends, end)
    before = [_plain(text[starts[k] : ends[k]]) for k in range(max(0, first - 2), first)]
    after = [_plain(text[starts[k] : ends[k]]) for k in range(last + 1, min(len(starts), last + 3))]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if before:
        out.append(f"{before[-1]} {shape(text[start:end])}")
    return out


def _has_digit_or_at(batch: pa.RecordBatch) -> list[bool]:
    import numpy as np

    data, offsets = W.utf8(batch.column("text"))
    some = np.concatenate([[0], np.cumsum(((data >= 0x30) & (data <= 0x39)) | (data == 0x40))])
    return (some[offsets[1:]] > some[offsets[:-1]]).tolist()


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SEEN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _read(fields: list[str]):
    """Spans of the fixed patterns; all seeds and candidates with their patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            base, seen = [], []
            for text, some in zip(batch.column("text").to_pylist(), _has_digit_or_at(batch)):
                seeds = base_spans(text) if some else []
                places = [*seeds, *((None, s, e) for s, e in candidates(text, seeds))] if some else []
                words = ([m.start() for m in WORD.finditer(text)], [m.end() for m in WORD.finditer(text)]) if places else ([], [])
                base.append([dict(zip(("kind", "start", "end"), x)) for x in seeds])
                seen.append([{"kind": k, "start": s, "end": e, "instance": text[s:e].lower(), "patterns": patterns_of(text, words, s, e)} for k, s, e in places])
            yield pa.record_batch([batch.column(f) for f in fields] + [pa.array(base, FOUND), pa.array(seen, SEEN)], names=[*fields, "base", "seen"])

    return run


def learn(edges: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, least: int = LEAST) -> DataFrame:
    """pattern, kind and score of the patterns that are trusted, from edges (pattern, instance, and kind of seeds)."""
    edges = saved(edges.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    seeds = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    known = seeds
    for turn in range(rounds):
        sums = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"))
        trusted = sums.join(sizes, "pattern").withColumn("trust", F.col("sum") / (F.col("n") + DOUBT)).where(F.col("trust") >= accept)
        trusted = saved(trusted.groupBy("pattern").agg(F.max_by(F.struct("kind", "trust"), F.struct("trust", "kind")).alias("x")).select("pattern", "x.kind", "x.trust"))
        if turn < rounds - 1:
            judged = edges.select("pattern", "instance").join(trusted, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("score"))
            new = judged.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("x")).select("instance", "x.kind", "x.score")
            known = seeds.union(new.join(seeds, "instance", "left_anti"))
    return trusted.select("pattern", "kind", F.col("trust").alias("score"))


def find(documents: DataFrame, text: str = "text", columns: list[str] | None = None, patterns: DataFrame | None = None, **options) -> DataFrame:
    """columns of documents (all, if not given) with base, spans and n_patterns (how many trusted ones the row holds).

    base and spans are arrays of (kind, start, end) in code points, end
    exclusive; spans holds those of base and the ones that trusted patterns add,
    by kind as in KINDS, then by start; added ones touch none of base.  The
    patterns are learnt from documents where none are given.  Null and empty
    texts have no spans; rows that are alike are each returned.  Columns of
    the names of added ones are replaced.
    """
    rest = [c for c in (documents.columns if columns is None else columns) if c not in ("base", "spans", "n_patterns")]
    inner = [f"c{i}" for i in range(len(rest))]
    frame = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, inner)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    fields = "".join(f"{n} {documents.schema[c].dataType.simpleString()}, " for c, n in zip(rest, inner))
    seen = "array<struct<kind:string,start:bigint,end:bigint,instance:string,patterns:array<string>>>"
    read = saved(frame.mapInArrow(_read(inner), f"{fields}base {SPANS}, seen {seen}").withColumn("row", F.monotonically_increasing_id()))
    every = read.where(F.size("seen") > 0).select("row", F.explode("seen").alias("x")).select("row", "x.*")
    if patterns is None:
        patterns = learn(every.select(F.explode("patterns").alias("pattern"), "instance", "kind"), **options)
    new = every.where("kind is null").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    new = new.join(patterns.select("pattern", F.col("kind").alias("by"), "score"), "pattern")
    new = new.groupBy("row", "start", "end").agg(F.max_by("by", F.struct("score", "by")).alias("kind"), F.count("*").alias("n"))
    new = new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"), F.sum("n").alias("n_patterns"))
    both = F.concat("base", F.coalesce("added", F.array().cast(SPANS)))
    place = lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["start"].alias("s"), x.alias("x"))
    spans = F.transform(F.array_sort(F.transform(both, place)), lambda x: x["x"])
    out = read.join(new, "row", "left").select(*[F.col(n).alias(c) for c, n in zip(rest, inner)], "base", spans.alias("spans"), F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"))
    return out
