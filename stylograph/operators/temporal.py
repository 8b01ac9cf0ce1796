"""As-of and interval joins.

As-of: both sides are dealt out by ranges of (key, time), so a key with a third of all rows spans many tasks. A task finds the last
right row among its own; what its first key had before comes from the tasks before it, a row a task.
Interval: a point meets the intervals of its key in bins of time; intervals are in all bins they touch, and the points of a crowded
bin are dealt into slices, each of which gets the bin's intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stage


def as_of(left: DataFrame, right: DataFrame, on: str, at: str, stage: Stage, tolerance: str | None = None, partitions: int | None = None, tie: str | None = None) -> DataFrame:
    """left's rows, each with `right` (struct of right's columns): of the rows of its key with a time no later than its own the last one; null if
    there is none, or if it is older than tolerance (an interval, as "1 hour").

    Of right rows of equal key and time the one with the largest `tie` counts (without tie, the largest row). Rows of left without key or time
    have no match; right rows without either are nobody's. Repeated rows of left each stay.
    """
    spark = left.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*(F.col(c) for c in right.columns))
    order = F.struct(F.col(tie), whole) if tie else whole
    last = right.filter(F.col(on).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(on).alias("k"), F.col(at).alias("t")).agg(F.max_by(whole, order).alias("r"))
    none = F.lit(None).cast(last.schema["r"].dataType)
    rows = left.select(F.col(on).alias("k"), F.col(at).alias("t"), F.struct(*(F.col(c) for c in left.columns)).alias("l"))
    usable = F.col("k").isNotNull() & F.col("t").isNotNull()
    both = rows.filter(usable).select("k", "t", F.lit(1).alias("s"), "l", none.alias("r")).unionByName(last.select("k", "t", F.lit(0).alias("s"), F.lit(None).cast(rows.schema["l"].dataType).alias("l"), "r"))
    # the digest lets many rows of one key and time go to different tasks
    dealt = both.withColumn("h", F.when(F.col("s") == 1, F.xxhash64("l"))).repartitionByRange(n, "k", "t", "s", "h")
    dealt = stage.table(dealt.withColumn("p", F.spark_partition_id()), "dealt")
    own = F.last("r", ignorenulls=True).over(Window.partitionBy("p", "k").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a row a task: its last key, and the last right row of that key in it
    ends = dealt.groupBy("p").agg(F.max("k").alias("end"))
    kept = dealt.filter("r is not null").groupBy("p", "k").agg(F.max_by("r", "t").alias("r"))
    ends = ends.join(kept, (ends["p"] == kept["p"]) & (ends["end"] == kept["k"]), "left").select(ends["p"].alias("p_"), "end", "r")
    before = ends.withColumn("carried", F.last("r", ignorenulls=True).over(Window.partitionBy("end").orderBy("p_").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carried = F.broadcast(before.select((F.col("p_")).alias("from_p"), "end", "carried"))  # a row a task
    firsts = dealt.groupBy("p").agg(F.min("k").alias("first"))
    into = firsts.join(carried, (firsts["first"] == F.col("end")) & (F.col("from_p") < firsts["p"])).groupBy("p", "first").agg(F.max_by("carried", "from_p").alias("carried"))
    into = F.broadcast(into.select(F.col("p").alias("into_p"), "first", "carried"))
    found = dealt.withColumn("own", own).filter("s = 1").join(into, (F.col("p") == F.col("into_p")) & (F.col("k") == F.col("first")), "left").withColumn("r", F.coalesce("own", "carried"))
    if tolerance:
        found = found.withColumn("r", F.when(F.col("r")[at] >= F.col("t") - F.expr(f"INTERVAL {tolerance}"), F.col("r")))
    return found.select("l.*", F.col("r").alias("right")).unionByName(rows.filter(~usable).select("l.*", none.alias("right")))


def within(points: DataFrame, intervals: DataFrame, on: str, at: str, start: str, end: str, stage: Stage, width: float, most: int = 100_000) -> DataFrame:
    """Pairs of a point and an interval of the same key with start <= at < end: columns point and interval (structs).

    at, start, end: timestamps or numbers; width: of a bin, in seconds or units, of the order of a usual interval (it sets the cost alone).
    Bins with over `most` points are cut into slices. Rows without key or times, and empty intervals, are in no pair.
    """
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if dict(df.dtypes)[c].startswith("timestamp") else F.col(c).cast("double")
    cell = lambda x: F.floor(x / width)
    x, a, b = number(points, at), number(intervals, start), number(intervals, end)
    pts = points.select(F.col(on).alias("k"), F.col(at).alias("x"), cell(x).alias("bin"), F.struct(*(F.col(c) for c in points.columns)).alias("point")).filter("k is not null and bin is not null")
    spans = intervals.filter(F.col(start) < F.col(end)).select(F.col(on).alias("k"), F.col(start).alias("a"), F.col(end).alias("b"), F.struct(*(F.col(c) for c in intervals.columns)).alias("interval"), F.explode(F.sequence(cell(a), cell(b))).alias("bin")).filter("k is not null")
    pts = stage.table(pts, "points")
    # at most points / most bins are crowded
    crowded = stage.table(pts.groupBy("k", "bin").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("k").alias("k_"), F.col("bin").alias("bin_"), F.ceil(F.col("n") / most).cast("int").alias("slices")), "crowded")
    cut = lambda df: df.join(F.broadcast(crowded), (F.col("k") == F.col("k_")) & (F.col("bin") == F.col("bin_")), "left").drop("k_", "bin_").withColumn("slices", F.coalesce("slices", F.lit(1)))
    p = cut(pts).withColumn("slice", F.pmod(F.xxhash64("point"), F.col("slices")).cast("int")).drop("slices")
    s = cut(spans).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return p.join(s, ["k", "bin", "slice"]).filter("x >= a and x < b").select("point", "interval")
