"""Exact order statistics of groups of any size, without sorting a group in one task or holding its values in a buffer.

Equal values are counted once. Then passes of histograms narrow each wanted rank to one cell: a pass splits the range that is left
into CELLS equal cells, counts the rows in them, and goes on with the least and the largest value of the cell that holds the rank. The
two ends of a range lie in different cells, so every pass leaves fewer values, and a rank is found when a single one is left.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stage

CELLS = 4096
#: Rows of a table that is broadcast at most; larger ones are joined by shuffles.
BROADCAST = 100_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint, if it has BROADCAST rows at most. df is to be a written or bounded table."""
    n = df.limit(BROADCAST + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST else df


def ranked(values: DataFrame, ranks: Column, stage: Stage, cells: int = CELLS, name: str = "ranks") -> DataFrame:
    """g, n, rank, value: for each group g of n values, the values at the wanted ranks.

    values: g (any type, null is a group of its own), v (a number; null and NaN don't count); ranks: array of ranks from 1, an
    expression of n; those outside 1..n are left out. A group without a value has no row.
    """
    counts = stage.table(values.filter("v is not null and not isnan(cast(v as double))").groupBy("g", F.col("v").cast("double").alias("v")).agg(F.count("*").alias("c")), f"{name}-counts")
    whole = counts.groupBy("g").agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    wanted = whole.withColumn("rank", F.explode(F.array_distinct(ranks))).filter("rank between 1 and n").withColumn("rank", F.col("rank").cast("bigint"))
    now = stage.table(wanted.withColumn("below", F.lit(0).cast("bigint")), f"{name}-0")
    done: list[DataFrame] = []
    for k in itertools.count(1):
        done.append(now.filter("low = high").select("g", "n", "rank", F.col("low").alias("value")))
        left = now.filter("low < high")
        if left.isEmpty():
            break
        ranges = left.select(F.col("g").alias("g_"), "n", "rank", "low", "high", "below")
        inside = counts.join(small(ranges), F.col("g").eqNullSafe(F.col("g_")) & F.col("v").between(F.col("low"), F.col("high")))
        # halves first, so that the width of a range can't overflow; that of the least numbers may vanish
        part = F.coalesce(F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2), F.lit(0.0))
        cell = F.when(F.col("v") == F.col("high"), cells - 1).when(F.col("v") == F.col("low"), 0).otherwise(F.least(F.lit(cells - 2), F.floor(part * cells)))
        by = inside.groupBy("g", "n", "rank", "below", cell.alias("cell")).agg(F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy("g", "rank").orderBy("cell"))  # a row a cell
        found = by.withColumn("upto", F.col("below") + upto).filter("upto >= rank and upto - c < rank")
        now = stage.table(found.select("g", "n", "low", "high", "rank", (F.col("upto") - F.col("c")).alias("below")), f"{name}-{k}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stage.table(out, name)


def quantiles(values: DataFrame, shares: list[float], stage: Stage, cells: int = CELLS, name: str = "quantiles") -> DataFrame:
    """g, n, share, value: linear quantiles, between the values at the two ranks next to (n - 1) * share."""
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array(*(r(at(p)) + 1 for p in shares for r in (F.floor, F.ceil)))
    found = ranked(values, ranks, stage, cells, name)
    asked = found.select("g", "n").distinct().withColumn("share", F.explode(F.array(*map(F.lit, map(float, shares)))))
    place = (F.col("n") - 1) * F.col("share")
    asked = asked.withColumns({"a": F.floor(place) + 1, "b": F.ceil(place) + 1, "part": place - F.floor(place)})
    low, high = (found.select(F.col("g").alias(f"g{x}"), F.col("rank").alias(f"r{x}"), F.col("value").alias(f"v{x}")) for x in "ab")
    both = asked.join(low, F.col("g").eqNullSafe(F.col("ga")) & (F.col("a") == F.col("ra"))).join(high, F.col("g").eqNullSafe(F.col("gb")) & (F.col("b") == F.col("rb")))
    return both.select("g", "n", "share", F.when(F.col("va") == F.col("vb"), F.col("va")).otherwise(F.col("va") * (1 - F.col("part")) + F.col("vb") * F.col("part")).alias("value"))
