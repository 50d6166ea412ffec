"""The data source of recordings: what is read, what is planned, and what a failing task leaves."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ultraframe.sources import recordings


def signal(n, seed=0):
    return np.round(np.random.default_rng(seed).uniform(-0.9, 0.9, n) * 2**15) / 2**15


@pytest.fixture()
def folder(tmp_path):
    for label, name, n in (("a", "one.wav", 1000), ("a", "two.WAV", 10), ("b", "three.wav", 2500), ("b", "empty.wav", 0)):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_bytes(recordings.encoded(signal(n, n), 8000 if label == "a" else 16000))
    (tmp_path / "b" / "bad.wav").write_bytes(b"RIFF....nothing")
    (tmp_path / "b" / "note.txt").write_bytes(b"x")
    return str(tmp_path)


def name_of(path):
    return os.path.basename(path)


def test_headers_read_44_bytes(spark, folder):
    rows = recordings.read(spark, folder, ["path", "class", "sample_rate", "n_frames", "bytes_read"]).collect()
    found = {name_of(r.path): tuple(r)[1:] for r in rows}
    assert found == {"one.wav": ("a", 8000, 1000, 44), "two.WAV": ("a", 8000, 10, 44), "three.wav": ("b", 16000, 2500, 44), "empty.wav": ("b", 16000, 0, 44), "bad.wav": ("b", None, None, 15)}


def test_whole_files(spark, folder):
    found = {name_of(r.path): r.samples for r in recordings.read(spark, folder).where("n_frames is not null").collect()}
    assert {k: len(v) for k, v in found.items()} == {"one.wav": 1000, "two.WAV": 10, "three.wav": 2500, "empty.wav": 0}
    assert np.array_equal(found["three.wav"], signal(2500, 2500))


@pytest.mark.parametrize("split", [64, 500, 1 << 20])
@pytest.mark.parametrize("block", [1, 7, 256, 5000])
def test_blocks_of_any_size_hold_every_sample_once(spark, folder, split, block):
    if block == 1 and split == 64:
        pytest.skip("many tiny tasks")
    source = recordings.Reader(recordings_schema(spark), {"path": folder, "block": str(block), "split": str(split)})
    rows = [r for p in source.partitions() for r in source.read(p)]
    for name, n in (("one.wav", 1000), ("two.WAV", 10), ("three.wav", 2500)):
        own = sorted((r[5], r[6]) for r in rows if name_of(r[0]) == name)
        assert [f for f, _ in own] == list(range(0, n, block))
        assert np.array_equal(np.concatenate([x for _, x in own]), signal(n, n))


def recordings_schema(spark):
    recordings.register(spark)
    return spark.createDataFrame([], recordings.SCHEMA).schema


def test_filters_reach_the_read(spark, folder):
    columns = ["path", "class", "first", "samples", "bytes_read"]
    blocks = recordings.read(spark, folder, columns, block=100)
    some = blocks.where((F.col("class") == "b") & (F.col("first") >= 1000) & (F.col("first") < 1300))
    rows = sorted(some.collect(), key=lambda r: r.first if isinstance(r.first, int) else r["first"])
    assert [r["first"] for r in rows] == [1000, 1100, 1200]
    assert np.array_equal(np.concatenate([r.samples for r in rows]), signal(2500, 2500)[1000:1300])
    assert sum(r.bytes_read for r in rows) == 44 + 3 * 200
    assert blocks.where("first > 2300").select("first").collect()[0][0] == 2400
    assert blocks.where("class in ('a', 'c')").select("path").distinct().count() == 2
    assert blocks.where("class = 'c'").count() == 0


def test_range_of_samples(spark, folder):
    rows = recordings.read(spark, folder, ["path", "first", "samples", "bytes_read"], **{"from": 5, "to": 8}).where("first is not null").collect()
    by = {name_of(r.path): r for r in rows}
    assert np.array_equal(by["three.wav"].samples, signal(2500, 2500)[5:8]) and by["three.wav"].bytes_read == 44 + 6
    assert by["empty.wav"].samples == [] and len(by["two.WAV"].samples) == 3


def test_plan_packs_small_files_and_cuts_long_ones(spark, folder):
    schema = recordings_schema(spark)
    few = recordings.Reader(schema, {"path": folder}).partitions()
    many = recordings.Reader(schema, {"path": folder, "block": "100", "split": "1000"}).partitions()
    assert len(few) == 1 and len(few[0].files) == 5
    assert len(many) > 5 and max(sum(to - at for *_, at, to in p.files) for p in many) <= 1000
    assert [p.files for p in recordings.Reader(schema, {"path": folder + "/nowhere"}).partitions()] == [[]]
    assert recordings.headers(spark, folder + "/nowhere").count() == 0


def wav(code, bits, channels, body, extra=b""):
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, code, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
    chunks = head + extra + struct.pack("<4sI", b"data", len(body)) + body
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


def test_formats(spark, tmp_path):
    x = signal(8)
    cases = {
        "float.wav": wav(3, 32, 1, x.astype("<f4").tobytes()),
        "stereo.wav": wav(1, 16, 2, (np.stack([x, -x], 1) * 2**15).astype("<i2").tobytes()),
        "wide.wav": wav(1, 24, 1, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x)),
        "listed.wav": wav(1, 16, 1, (x * 2**15).astype("<i2").tobytes(), struct.pack("<4sI", b"LIST", 5) + b"hello\0"),
        "cut.wav": wav(1, 16, 1, (x * 2**15).astype("<i2").tobytes())[:-4],
        "law.wav": wav(7, 8, 1, b"12345678"),
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    found = {name_of(r.path): r.samples for r in recordings.read(spark, str(tmp_path)).collect()}
    assert np.allclose(found["float.wav"], x) and np.allclose(found["stereo.wav"], 0)
    assert np.allclose(found["wide.wav"], x, atol=2**-22) and np.array_equal(found["listed.wav"], x)
    assert np.array_equal(found["cut.wav"], x[:-2]) and found["law.wav"] is None
    with pytest.raises(Exception, match="Damaged"):
        recordings.read(spark, str(tmp_path), damaged="fail").collect()


def files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_written_files_come_back(spark, tmp_path):
    rows = [(f"x/{i}.wav", [float(v) for v in signal(20, i)], 8000 + i) for i in range(12)]
    frame = spark.createDataFrame(rows, "name string, samples array<double>, sample_rate int").repartition(4)
    root = str(tmp_path / "out")
    recordings.write(frame, root)
    back = {name_of(r.path): (r["class"], r.sample_rate, r.samples) for r in recordings.read(spark, root).collect()}
    assert back == {f"{i}.wav": ("x", 8000 + i, rows[i][1]) for i in range(12)}
    recordings.write(frame.limit(1).withColumn("name", F.lit("y.wav")), root)
    assert len(files(root)) == 13
    recordings.write(frame.limit(1).withColumn("name", F.lit("z.wav")), root, overwrite=True)
    assert files(root) == ["z.wav"]


def test_failing_task_leaves_no_file(spark, tmp_path):
    root = str(tmp_path / "out")
    recordings.write(spark.createDataFrame([("old.wav", [0.5])], "name string, samples array<double>"), root)
    rows = [(f"{i}.wav" if i != 17 else "../bad.wav", [0.0] * 5) for i in range(40)]
    frame = spark.createDataFrame(rows, "name string, samples array<double>").repartition(8)
    for overwrite in (False, True):
        with pytest.raises(Exception, match="no name below"):
            recordings.write(frame, root, overwrite=overwrite)
        assert files(root) == ["old.wav"] and os.listdir(root) == ["old.wav"]
    twice = spark.createDataFrame([("a.wav", [0.0]), ("a.wav", [0.1])], "name string, samples array<double>")
    with pytest.raises(Exception, match="same name"):
        recordings.write(twice, root)
    assert files(root) == ["old.wav"]


@pytest.mark.parametrize("schema", ["name string", "samples array<double>"])
def test_what_is_written_needs_name_and_samples(spark, tmp_path, schema):
    with pytest.raises(Exception, match="are written from"):
        recordings.write(spark.createDataFrame([], schema), str(tmp_path / "out"))
