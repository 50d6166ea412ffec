"""Mixing sources to target weights by systematic sampling (operator 4).

Only DataFrame functions.  The documents of a source stand in one order, the
longest first; each is expected to come some number of times, and the running
sum of expected copies plus one random offset crosses an integer as many times
as the document is emitted.

The LONG longest documents of a source decide how near the words taken come to
the target, so what each of them is expected to come depends on those before it:
the words still wanted, over the words still to come, and no fewer or more copies
than those after it can make up for.  They are a fold over one array for each
source.  All others of the source have the rate that is left after
them, and since each is short beside the whole, their sum is near to it.  The
running sum over these is distributed: a source is cut into chunks of about CHUNK
documents that are consecutive in the order, each chunk numbers its own rows, and
a small table of chunk counts gives the numbers before it.  A source with a third
of all rows is many chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import saved

#: Rows that one window of row numbers takes, about.
CHUNK = 50_000
#: Longest documents of a source whose expected copies are adjusted one by one.
LONG = 1000
#: Most copies of a word, and so the largest target as a multiple of the source.
MOST = 3
#: Rows that a table of sources, bands or chunks may have to be broadcast; beyond them the join is shuffled.
BROADCAST = 100_000


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size") -> DataFrame:
    """Adds target, in the unit of size, to a table with one row for each source.

    Sources in code-point order, null last, weigh 1, 2, 3 and so on again, and
    share the sum of all sizes; none gets over MOST times its size, and what
    is over goes to the others by weight.  This is water-filling: in the order
    of MOST * size / weight, the sources that stop at their limit come first.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source))
    total = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_full"), F.col("_place"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("_place", F.row_number().over(by_name)).withColumn("_weight", (F.col("_place") - 1) % 3 + 1)
    out = out.withColumn("_full", MOST * F.col(size) / F.col("_weight"))
    out = out.withColumn("_level", (F.sum(size).over(total) - F.coalesce(MOST * F.sum(size).over(before), F.lit(0))) / (F.sum("_weight").over(total) - F.coalesce(F.sum("_weight").over(before), F.lit(0))))
    out = out.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_place", "_level"))).over(total)["_level"])
    out = out.withColumn("target", F.least((MOST * F.col(size)).cast("double"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_weight")))
    return out.drop("_place", "_weight", "_full", "_level")


def _small(table: DataFrame) -> DataFrame:
    """table, saved; broadcast in joins if it has few rows."""
    table = saved(table)
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _rate(target: Column, taken: Column, left: Column) -> Column:
    return F.when(left > 0, F.least(F.lit(float(MOST)), F.greatest(F.lit(0.0), (target - taken) / left))).otherwise(0.0)


def _one_by_one(sizes: Column, target: Column, source_size: Column, offset: Column) -> Column:
    """Copies of documents of these sizes, the words taken, the words of all others, and the offset after them."""
    start = F.struct(F.lit(0).cast("bigint").alias("taken"), source_size.alias("left"), offset.alias("offset"), F.array().cast("array<bigint>").alias("copies"))

    def step(s: Column, size: Column) -> Column:
        want, rest = target - s["taken"], MOST * (s["left"] - size)
        # From low to high copies, those after it can still make up for it; where none will do, the nearer one.
        low, high = F.ceil((want - rest) / size).cast("double"), F.floor(want / size).cast("double")
        nearer = F.when(want - high * size - rest <= low * size - want, high).otherwise(low)
        rate = _rate(target, s["taken"], s["left"])
        rate = F.when(size == 0, rate).when(low > high, nearer).otherwise(F.least(F.greatest(rate, low), high))
        to = s["offset"] + F.least(F.greatest(rate, F.lit(0.0)), F.lit(float(MOST)))
        n = F.least(F.floor(to), F.lit(MOST)).cast("bigint")
        return F.struct((s["taken"] + n * size).alias("taken"), (s["left"] - size).alias("left"), (to - n).alias("offset"), F.concat(s["copies"], F.array(n)).alias("copies"))

    return F.aggregate(sizes, start, step)


def mix(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", seed: int = 1, chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """documents, whose column size is a bigint, with source_size, target and copies.

    documents is written once to the checkpoint folder and read from there,
    so that texts are not counted anew for each of the steps.

    A document of size 0 is copied like others of its source, which changes
    no word count; a null size counts as 0.  A source of size 0 has target 0
    and no copies.  Null is a source of its own.  Rows that are alike in id, size
    and source share what falls to them; which of them gets it does not
    matter.  Columns named like the added ones are replaced; others come back
    as they are, whatever their names.
    """
    own = [c for c in documents.columns if c not in ("source_size", "target", "copies")]
    whole = F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("size") if c == size else F.col(f"`{c}`") for c in own])
    number = lambda text: F.conv(F.substring(F.md5(text), 1, 12), 16, 10)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(f"`{doc_id}`").cast("string")))
    words = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint")
    name = F.struct(F.col(f"`{source}`").isNull().alias("n"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("s"))
    docs = saved(documents.select(whole.alias("row"), key.alias("key"), words.alias("size"), name.alias("source")))
    digits = F.col("size").cast("string")
    docs = docs.withColumn("band", F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int"))

    # One row for each source, in windows over all of them: sources are few beside documents.
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source.withColumn("name", F.when(~F.col("source.n"), F.col("source.s"))), "name").drop("name")
    goal = goal.withColumn("offset", number(F.concat(F.lit(f"{seed}|"), F.col("source.s"))).cast("double") / float(16**12))

    longest = Window.partitionBy("source").orderBy(F.desc("size"), F.desc("key"))
    first = saved(docs.withColumn("place", F.row_number().over(longest)).where(F.col("place") <= long + 1))
    edge = first.groupBy("source").agg(F.max(F.when(F.col("place") == long + 1, F.struct("size", "key"))).alias("edge"), F.array_sort(F.collect_list(F.struct("place", "size", "key"))).alias("list"))
    # Rows that are equal to the first of the others are among the others.
    listed = F.filter("list", lambda x: F.col("edge").isNull() | (F.struct(x["size"].alias("size"), x["key"].alias("key")) > F.col("edge")))
    fold = edge.join(goal, "source").withColumn("list", listed)
    fold = fold.withColumn("fold", _one_by_one(F.transform("list", lambda x: x["size"]), F.col("target"), F.col("source_size"), F.col("offset")))
    fold = saved(fold.select("source", "source_size", "target", "edge", F.size("list").alias("listed"), "fold"))

    copies = fold.select("source", "source_size", "target", F.posexplode("fold.copies").alias("at", "copies")).withColumn("place", F.col("at") + 1)
    out = first.join(copies, ["source", "place"]).select("row", "source_size", "target", "copies")

    rate = _rate(F.col("target"), F.col("fold.taken"), F.col("fold.left"))
    goal = _small(fold.where("edge is not null").select("source", "source_size", "target", "edge", rate.alias("rate"), F.col("fold.offset").alias("offset")))
    rest = docs.join(goal, "source").where(F.struct("size", "key") <= F.col("edge"))
    bands = docs.groupBy("source", "band").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    rest = rest.join(_small(bands), ["source", "band"]).withColumn("part", F.conv(F.substring("key", 1, 12), 16, 10).cast("bigint") % F.col("parts"))
    order = Window.partitionBy("source").orderBy(F.desc("band"), "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rest.groupBy("source", "band", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    row = Window.partitionBy("source", "band", "part").orderBy(F.desc("size"), "key")
    rest = rest.withColumn("number", F.row_number().over(row)).join(_small(counts), ["source", "band", "part"])
    place = F.col("before") + F.col("number")
    crossed = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    rest = rest.select("row", "source_size", "target", F.least(crossed, F.lit(MOST)).cast("bigint").alias("copies"))
    return out.union(rest).select("row.*", "source_size", "target", "copies")


def sample(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """The mix itself: each document as often as it has copies, numbered from 1 in copy.

    Only ids, sources and sizes go through the sampling; the texts are shuffled
    once, to meet their numbers of copies.
    """
    documents = documents.drop("copy")
    own = [F.col(f"d.`{c}`") for c in documents.columns]
    keyed = documents.alias("d").select(F.struct(*own).alias("d"), F.xxhash64(*[F.col(f"d.`{c}`") for c in (doc_id, source, text)]).alias("key"))
    slim = keyed.select(F.col(f"d.`{doc_id}`").alias("doc_id"), F.col(f"d.`{source}`").alias("source"), word_count(F.col(f"d.`{text}`")).alias("size"), "key")
    mixed = saved(mix(slim, seed=seed).groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"))
    out = keyed.join(mixed.where("rows = 1"), "key")
    alike = mixed.where("rows > 1")
    if not alike.isEmpty():  # of rows that are alike one stands for all
        out = out.union(keyed.join(alike, "key").dropDuplicates(["key"]))
    return out.select("d.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
