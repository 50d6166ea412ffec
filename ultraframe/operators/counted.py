"""Exact percentiles by counting, for groups of any size and any number of groups.

First come the number, the least and the greatest value of each group.  A group
is then counted into bins between its ends, and the bin that holds the wanted
rank again into finer ones, until one value or at most FEW values are left,
which are sorted.  There is a bin for every SHARE values, so counts are always
far fewer than values; no task holds the values of a group, and there are more
tasks where there are more values.
"""

from __future__ import annotations

from functools import partial
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from ..sources.storage import Written, write

#: Bins of a round: one for so many values of a group, but at least and at most so many.
SHARE, LEAST, BINS = 8, 4, 4096
#: Values of a bin that are sorted instead of counted again.
FEW = 16
#: Values that a task counts.  The states of larger groups, or of all where there are so few, go to all tasks instead of being dealt out with the values.
VALUES, GROUPS = 2_000_000, 10_000


def _chosen(counted: DataFrame, by: list[str]) -> DataFrame:
    """The bin of each group that holds its rank, with the rank within it; above is the least value over the bin."""
    order = Window.partitionBy(*by).orderBy("bin")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_rank", F.col("rank") - before).withColumn("_above", F.coalesce(F.lead("low").over(order), "above"))
    return placed.where("_rank >= 0 and _rank < n").select(*by, "share", F.col("_rank").alias("rank"), F.col("_above").alias("above"), "n", "low", "high")


def _inside(values: DataFrame, state: DataFrame, by: list[str], tasks: int, large: DataFrame | None, bins: int) -> DataFrame:
    """by, share, rank, above, x and its bin, a row for each value between the ends of its group's state."""
    if state.count() <= GROUPS:
        both = values.join(F.broadcast(state), by)
    else:  # the states of a task's groups are held, its values pass by
        rest = values.join(F.broadcast(large), by, "left_anti") if large is not None else values
        both = rest.repartition(tasks, *by).join(state.repartition(tasks, *by).hint("shuffle_hash"), by)
        if large is not None:
            both = both.unionByName(values.join(F.broadcast(state.join(F.broadcast(large), by, "left_semi")), by))
    spread = both.select(*by, "share", "rank", "above", "n", "low", "high", F.explode("x").alias("x")).where("x between low and high")
    last = F.least(F.lit(bins - 1), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / SHARE)))
    return spread.select(*by, "share", "rank", "above", "x", F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * last).alias("bin"))


def percentiles(values: DataFrame, by: list[str], q: float, coarse: Column | None = None, x: str = "x", bins: int = BINS) -> DataFrame:
    """by and value: the percentile q (0 to 1) of x in each group, between two values in proportion.

    x is a number or an array of numbers; only finite ones count.  coarse, once
    the bins of the first round, is no longer needed: they follow from the group.
    """
    chunk = F.col(x) if isinstance(values.schema[x].dataType, ArrayType) else F.array(x)
    kept = write(values.select(*by, F.filter(chunk, lambda v: F.abs(v) < float("inf")).alias("x")).where(F.size("x") > 0))
    place = (F.col("n") - 1) * q
    ends = kept.frame.groupBy(*by).agg(F.sum(F.size("x")).alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    state = write(ends.select(*by, (place - F.floor(place)).alias("share"), F.floor(place).alias("rank"), F.lit(None).cast("double").alias("above"), "n", "low", "high"))
    total, longest = (v or 0 for v in state.frame.agg(F.sum("n"), F.max("n")).first())
    tasks = max(kept.frame.sparkSession.sparkContext.defaultParallelism, ceil(total / VALUES))
    # At most one group for each of these tasks.
    sent = write(state.frame.where(F.col("n") > VALUES).select(*by)) if longest > VALUES else None
    inside = partial(_inside, by=by, tasks=tasks, large=sent and sent.frame, bins=bins)
    # Of two neighbouring ranks the upper one is either in the bin of the lower one or the least value above it.
    settled, few = "low = high or rank = n - 1", f"n <= {FEW}"
    ended, left, used = [], [], [kept, *([sent] if sent else [])]
    near: Written | None = None
    while True:
        used.append(state)
        upper = F.when(F.col("rank") < F.col("n") - 1, F.col("high")).otherwise(F.coalesce("above", "high"))
        ended.append(state.frame.where(settled).select(*by, "share", F.col("high").alias("lower"), upper.alias("upper")))
        left.append(state.frame.where(f"not ({settled}) and {few}"))
        open_ = state.frame.where(f"not ({settled}) and not ({few})")
        if open_.isEmpty():
            break
        counted = inside(near.frame if near else kept.frame, open_).groupBy(*by, "share", "rank", "above", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        state = write(_chosen(counted, by))
        if near is None:  # from here on only values of the bins in question, and of groups that were small from the start
            asked = state.frame.unionByName(left[0]).where(f"not ({settled})")
            near = write(inside(kept.frame, asked).select(*by, F.array("x").alias("x")))
            used.append(near)
    small = left[0]
    for more in left[1:]:
        small = small.unionByName(more)
    lists = inside(near.frame if near else kept.frame, small).groupBy(*by, "share", "rank", "above").agg(F.sort_array(F.collect_list("x")).alias("x"))
    found = lists.select(*by, "share", F.get("x", F.col("rank").cast("int")).alias("lower"), F.get("x", F.col("rank").cast("int") + 1).alias("upper"))
    for more in ended:
        found = found.unionByName(more)
    result = write(found.select(*by, (F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("share")).alias("value")))
    for table in used:
        table.drop()
    return result.frame
