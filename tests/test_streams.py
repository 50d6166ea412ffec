"""State over streams: order, late rows, and what is left open."""

from pyspark.sql import functions as F

from ultraframe.streaming.best import running_best
from ultraframe.streaming import replay as replays
from ultraframe.streaming.replay import STATE_STORE


def arrivals(spark, folder, batches, late):
    """running_best of a stream of these batches of (run, day, accuracy)."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "run long, day int, accuracy double").select("run", F.timestamp_seconds(F.col("day") * 86400).alias("epoch"), "accuracy").coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    source = spark.readStream.schema("run long, epoch timestamp, accuracy double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        found = running_best(source, late)
        found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out").collect()
    return sorted((r.run, int(r.epoch.timestamp() // 86400), r.saved) for r in rows)


def test_order_late_rows_and_open_ones(spark, tmp_path):
    batches = [
        [(1, 12, 0.5), (2, 10, 0.0)],
        [(1, 10, 0.6), (1, 11, 0.2), (2, 14, 0.3)],  # before what came first, but not too late
        [(1, 30, 0.55)],
        [(1, 13, 0.9), (2, 40, 0.2)],  # by now the watermark has passed 13: dropped
        [(3, 60, 1.0)],
    ]
    found = arrivals(spark, str(tmp_path), batches, "3 days")
    assert found == [(1, 10, True), (1, 11, False), (1, 12, False), (1, 30, False), (2, 10, False), (2, 14, True), (2, 40, False)]


def test_many_runs_take_a_call_a_bucket_and_batches_several_files(spark, monkeypatch):
    """A best for each of many runs, null among them, whose rows come late in batches of several files."""
    monkeypatch.setattr(replays, "ROWS", 400)
    rows = spark.range(12000).select(F.when(F.col("id") % 700 == 0, None).otherwise(F.col("id") % 700 + (1 << 60)).alias("run"), F.timestamp_seconds((F.col("id") * 7919 % 12000 + 9000) * 3600).alias("epoch"), (F.xxhash64("id") % 50 / 50).alias("accuracy"))
    closing = {"run": F.lit(-1), "epoch": F.lit("2200-01-01"), "accuracy": F.lit(0.0)}
    found = [r for r in replays.replay(rows, "epoch", F.col("epoch"), 10 * 86400, 4, closing, lambda s: running_best(s, "11 days", buckets=5)).collect() if r.run != -1]
    expected, best = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.epoch):
        expected[r.run, r.epoch] = r.accuracy > best.get(r.run, 0.0)
        best[r.run] = max(best.get(r.run, 0.0), r.accuracy)
    assert len(found) == 12000 and {(r.run, r.epoch): r.saved for r in found} == expected
