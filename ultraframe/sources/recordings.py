"""WAV recordings as a Spark data source: `recordings`, read in ranges and written in two phases.

Reading plans partitions by bytes: files are packed together, long ones are cut
between blocks of samples.  Only what the schema asks for is read: without
samples that is the header.  Filters on path, class and on the samples' place
reach the plan, so blocks outside them are never touched.

Files are reached through pyarrow's file systems (local paths, file, hdfs, s3,
gs and abfs addresses), from the driver for the plan and the commit, and from
executors for content.
"""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

# The least header of a WAV file, and its codes for plain and for floating-point samples.
HEADER, PCM, FLOAT, EXTENSIBLE = 44, 1, 3, 0xFFFE
#: Bytes of content that one task reads, about.
SPLIT = 64 << 20
SCHEMA = "path string, class string, sample_rate int, channels int, n_frames bigint, first bigint, samples array<double>, bytes_read bigint"


class Damaged(ValueError):
    """A file that is no WAV of plain or floating-point samples."""


class Counted:
    """A file that counts the bytes read of it."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file, self.bytes = system.open_input_file(path), 0

    def read(self, n: int, at: int) -> bytes:
        data = self.file.read_at(n, at)
        self.bytes += len(data)
        return data


@dataclass(frozen=True)
class Format:
    """What a header says: where samples lie and how they are written."""

    rate: int
    channels: int
    width: int
    floating: bool
    offset: int
    n_frames: int

    @property
    def frame(self) -> int:
        return self.channels * self.width

    def decoded(self, data: bytes) -> np.ndarray:
        """Mono samples, plain ones from -1 to 1."""
        data = data[: len(data) // self.frame * self.frame]
        if self.floating:
            x = np.frombuffer(data, f"<f{self.width}").astype(np.float64)
        elif self.width == 1:
            x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
        elif self.width == 3:
            b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float64) / 2**23
        else:
            x = np.frombuffer(data, f"<i{self.width}").astype(np.float64) / 2 ** (8 * self.width - 1)
        return x.reshape(-1, self.channels).mean(axis=1)


def header(file: Counted, size: int) -> Format:
    """The format of a file of so many bytes; more than the first 44 are read only where other chunks come first."""
    start = file.read(min(HEADER, size), 0)
    if start[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise Damaged("no RIFF header")
    at, found = 12, None
    while at + 8 <= size:
        head = start[at : at + 8] if at + 8 <= len(start) else file.read(8, at)
        if len(head) < 8:
            break
        name, length = struct.unpack("<4sI", head)
        if name == b"fmt ":
            body = start[at + 8 : at + 24] if at + 24 <= len(start) else file.read(16, at + 8)
            if len(body) < 16:
                break
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body)
            if code == EXTENSIBLE and length >= 26:
                code = struct.unpack("<H", file.read(2, at + 32))[0]
            width = bits // 8
            if code not in (PCM, FLOAT) or not channels or not rate or width not in ((4, 8) if code == FLOAT else (1, 2, 3, 4)):
                raise Damaged(f"code {code} with {bits} bits")
            found = (rate, channels, width, code == FLOAT)
        elif name == b"data":
            if found is None:
                break
            # A length beyond the file is of a recording that was cut short.
            return Format(*found, at + 8, min(length, size - at - 8) // (found[1] * found[2]))
        at += 8 + length + length % 2
    raise Damaged("no samples")


@dataclass
class Part(InputPartition):
    """Files, or ranges of bytes of them: path, class, size, from, up to."""

    files: list[tuple[str, str | None, int, int, int]]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    system, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    return system, inner.rstrip("/")


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = [f.name for f in schema.fields]
        self.root = options["path"]
        self.endings = tuple(e.strip().lower() for e in options.get("endings", ".wav").split(","))
        self.block = int(options.get("block", 0))
        self.split = int(options.get("split", SPLIT))
        self.low, self.high = int(options.get("from", 0)), None
        if "to" in options:
            self._until(int(options["to"]))
        self.damaged = options.get("damaged", "null")
        self.equal: dict[str, set[str]] = {}
        if self.damaged not in ("null", "fail"):
            raise ValueError("damaged is null or fail")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes in filters on path and class; bounds of first cut what is read, and Spark still applies them."""
        for f in filters:
            match f:
                case EqualTo((("path" | "class") as name,), value):
                    self._only(name, {value})
                case In((("path" | "class") as name,), values):
                    self._only(name, set(values))
                case GreaterThanOrEqual(("first",), value) if self.block:
                    self.low = max(self.low, value)
                    yield f
                case GreaterThan(("first",), value) if self.block:
                    self.low = max(self.low, value + 1)
                    yield f
                case LessThan(("first",), value) if self.block:
                    self._until(value)
                    yield f
                case LessThanOrEqual(("first",), value) if self.block:
                    self._until(value + 1)
                    yield f
                case EqualTo(("first",), value) if self.block:
                    self.low = max(self.low, value)
                    self._until(value + 1)
                    yield f
                case _:
                    yield f

    def _only(self, name: str, values: set[str]) -> None:
        self.equal[name] = self.equal.get(name, values) & values

    def _until(self, first: int) -> None:
        """No sample from first on; no block that begins there."""
        last = -(-first // self.block) * self.block if self.block else first
        self.high = last if self.high is None else min(self.high, last)

    def partitions(self) -> list[Part]:
        system, root = _system(self.root)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return [Part([])]
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        parts, now, held = [], [], 0
        for i in sorted((i for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(self.endings)), key=lambda i: i.path):
            below = i.path[len(root) + 1 :].split("/")
            own = below[0] if len(below) > 1 else None
            if not all((i.path if c == "path" else own) in values for c, values in self.equal.items()):
                continue
            whole = "samples" not in self.names or not self.block
            cost = min(i.size, HEADER * 64) if "samples" not in self.names else i.size
            for at in [0] if whole else range(0, max(1, i.size), self.split):
                to = i.size if whole else min(i.size, at + self.split)
                if now and held + min(cost, to - at) > self.split:
                    parts.append(Part(now))
                    now, held = [], 0
                now.append((i.path, own, i.size, at, to))
                held += min(cost, to - at)
        return parts + [Part(now)] if now or not parts else parts

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = _system(self.root)
        for path, label, size, low, high in partition.files:
            file = Counted(system, path)
            try:
                form = header(file, size)
            except Damaged:
                if self.damaged == "fail":
                    raise
                if low == 0:
                    yield self._row(path, label, None, None, None, file.bytes)
                continue
            if "samples" not in self.names and not self.block:
                yield self._row(path, label, form, None, None, file.bytes)
                continue
            for first, n in self._blocks(form, low, high, size):
                x = form.decoded(file.read(n * form.frame, form.offset + first * form.frame)).tolist() if "samples" in self.names else None
                yield self._row(path, label, form, first, x, file.bytes)
                file.bytes = 0

    def _blocks(self, form: Format, low: int, high: int, size: int) -> Iterator[tuple[int, int]]:
        """First sample and length of the blocks that begin within these bytes of the file and within the range asked for."""
        end = form.n_frames if self.high is None else min(self.high, form.n_frames)
        if not self.block:
            first = min(self.low, form.n_frames)
            yield first, max(0, end - first)
            return
        # The block at or after a byte; bytes before the samples belong to the first block.
        after = lambda byte: max(0, -(-(byte - form.offset) // (form.frame * self.block)))
        last = after(high) if high < size else -(-form.n_frames // self.block)
        for number in range(max(after(low) if low else 0, -(-self.low // self.block)), min(last, -(-end // self.block))):
            first = number * self.block
            yield first, min(self.block, form.n_frames - first)

    def _row(self, path: str, label: str | None, form: Format | None, first: int | None, samples: list[float] | None, read: int) -> tuple:
        all_of = {"path": path, "class": label, "sample_rate": form and form.rate, "channels": form and form.channels, "n_frames": None if form is None else form.n_frames, "first": first, "samples": samples, "bytes_read": read}
        return tuple(all_of[c] for c in self.names)


@dataclass
class Staged(WriterCommitMessage):
    """Files of one task, as they wait to be moved: where they are, and where they go."""

    moves: list[tuple[str, str]]


def _remove(system: fs.FileSystem, folder: str) -> None:
    """Deletes a folder that others may still be writing to."""
    for last in (False, False, False, True):
        if system.get_file_info(folder).type != fs.FileType.Directory:
            return
        try:
            system.delete_dir(folder)
        except OSError:
            if last:
                raise
            time.sleep(0.2)


class Writer(DataSourceWriter):
    """Writes name and samples (or content) as files: each task to a folder of its own, which the commit moves into place and an abort removes.

    The folders lie in one that the plan has made: a task that outlives an abort no longer finds it, and fails.
    """

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.names = [f.name for f in schema.fields]
        if "name" not in self.names or not {"samples", "content"} & set(self.names):
            raise ValueError("recordings are written from name and samples, or name and content")
        self.root, self.rate, self.overwrite = options["path"], int(options.get("rate", 44100)), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        system, root = _system(self.root)
        system.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, rows: Iterator) -> Staged:
        system, root = _system(self.root)
        own, moves = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(own, recursive=False)
        try:
            for row in rows:
                name = row["name"]
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name!r} is no name below the folder")
                content = row["content"] if "content" in self.names else encoded(row["samples"], row["sample_rate"] if "sample_rate" in self.names else self.rate)
                place = f"{own}/{len(moves)}"
                with system.open_output_stream(place) as out:
                    out.write(content)
                moves.append((place, f"{root}/{name}"))
        except Exception:
            _remove(system, own)
            raise
        return Staged(moves)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = _system(self.root)
        moves = [move for m in messages if m is not None for move in m.moves]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two recordings have the same name")
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if i.base_name != self.staging:
                    (system.delete_dir if i.type == fs.FileType.Directory else system.delete_file)(i.path)
        for folder in {to.rsplit("/", 1)[0] for _, to in moves}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: system.move(*move), moves))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = _system(self.root)
        _remove(system, f"{root}/{self.staging}")


def encoded(samples: list[float], rate: int) -> bytes:
    """Mono samples as 16-bit WAV."""
    body = (np.clip(np.asarray(samples if samples is not None else [], dtype=np.float64), -1, 1 - 2**-15) * 2**15).round().astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16, b"data", len(body)) + body


class Recordings(DataSource):
    """Options: path; endings (.wav); block, samples in a row (0: a file is one row); split, bytes a task; from and to, a range of samples, or of blocks that begin there; damaged, null or fail; rate, of what is written."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach it."""
    spark.dataSource.register(Recordings)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    """Recordings below path with these columns (all of SCHEMA but bytes_read, if none are named)."""
    register(spark)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    unknown = set(columns or ()) - set(kinds)
    if unknown:
        raise ValueError(f"no columns {sorted(unknown)}")
    own = [c for c in kinds if c != "bytes_read"] if columns is None else columns
    reader = spark.read.format("recordings").schema(", ".join(f"{c} {kinds[c]}" for c in own))
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


def headers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """path, class, sample_rate, n_frames; nulls where the header can't be read; only headers are read."""
    return read(spark, path, ["path", "class", "sample_rate", "n_frames"], **options)


def write(frame: DataFrame, path: str, rate: int = 44100, overwrite: bool = False) -> None:
    """Writes name and samples (with sample_rate, or all at rate), or name and content, as files below path; all appear when the last task is done."""
    register(frame.sparkSession)
    frame.write.format("recordings").option("rate", str(rate)).mode("overwrite" if overwrite else "append").save(path)
