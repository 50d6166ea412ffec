"""The best so far of each run over a stream, with state of its own.

Rows come in any order.  A row waits in state until the watermark has passed its
time; then it is compared with the best of all rows before it.  A run holds one
number and the rows of the time that the watermark lags behind, however long it
goes on.  Rows that come later than that are dropped; a row without a time never
passes.  Runs are dealt to buckets, whose runs are kept and compared together as
arrays, so that a batch costs a call for each bucket and not one for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run bigint, at bigint, accuracy double, saved boolean"
#: The best of each run, and rows that wait, run by run in no order.
STATE = "run array<bigint>, best array<double>, waiting_run array<bigint>, waiting_at array<bigint>, waiting_accuracy array<double>"
#: Buckets of runs.  Each takes in memory its runs and what of them waits.
BUCKETS = 256


def compared(due: pd.DataFrame, best: pd.Series) -> tuple[pd.DataFrame, pd.Series]:
    """due (run, at, accuracy) in order with saved, and the best by run after it."""
    due = due.sort_values(["run", "at", "accuracy"], kind="stable", ignore_index=True)
    known = due["accuracy"].fillna(-np.inf)
    first = due["run"].map(best).fillna(0.0)
    before = np.maximum(known.groupby(due["run"]).cummax().groupby(due["run"]).shift(fill_value=-np.inf), first)
    now = np.maximum(known, before).groupby(due["run"]).last()
    return due.assign(saved=known > before), pd.concat([best[~best.index.isin(now.index)], now])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes in the new rows of a bucket and gives out those that the watermark has passed."""
    passed = state.getCurrentWatermarkMs() * 1000
    runs, values, *held = state.get if state.exists else ([], [], [], [], [])
    best = pd.Series(np.array(values, np.float64), index=np.array(runs, np.int64))
    waiting = pd.DataFrame({n: np.array(x, t) for n, x, t in zip(("run", "at", "accuracy"), held, (np.int64, np.int64, np.float64))})
    if not state.hasTimedOut:
        for new in batches:
            new = new[new["at"] > passed] if passed > 0 else new  # what was before them has gone out
            waiting = pd.concat([waiting, new[list(waiting.columns)].astype(waiting.dtypes)], ignore_index=True)
    out = waiting["at"] <= passed
    due, later = waiting[out], waiting[~out]
    if len(due):
        due, best = compared(due, best)
    state.update((best.index.tolist(), best.tolist(), *(later[c].tolist() for c in later)))
    if len(later):
        state.setTimeoutTimestamp(max(1, int(later["at"].min()) // 1000))
    if len(due):
        yield due if key[0] >= 0 else due.assign(run=None)


def running_best(epochs: DataFrame, late: str, buckets: int = BUCKETS) -> DataFrame:
    """run, epoch, accuracy, saved for a stream of (run, epoch as a timestamp, accuracy), each row once the watermark, late behind, has passed it.

    saved says whether accuracy exceeds 0 and all before in its run.  The number
    of buckets must stay while a stream goes on.
    """
    own = epochs.select(F.col("run").cast("bigint").alias("run"), F.col("epoch").cast("timestamp").alias("epoch"), F.col("accuracy").cast("double").alias("accuracy"))
    # Times in microseconds, which know no zones; a run that is null has a bucket of its own.
    timed = own.where("epoch is not null").withWatermark("epoch", late).withColumn("at", F.unix_micros("epoch"))
    dealt = timed.withColumn("bucket", F.when(F.col("run").isNull(), -1).otherwise(F.pmod(F.xxhash64("run"), F.lit(buckets))).cast("int")).withColumn("run", F.coalesce("run", F.lit(0)))
    found = dealt.groupBy("bucket").applyInPandasWithState(_advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("run", F.timestamp_micros("at").alias("epoch"), "accuracy", "saved")
