"""What the operators share: scratch tables in the shared folder, table reading, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped_at_exit, shared_dir

#: ASCII white space of the word rule [^\x20\x09-\x0D]+.
WHITE = " \t\n\x0b\x0c\r"


class Scratch:
    """Tables that cut lineage: written once to the shared folder, read by later stages, dropped by close() or with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        dropped_at_exit(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; the schema is given so that an empty table can be read."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """A table that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self.drop("")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def draw_limit(wanted: int, there: int) -> int:
    """The largest 64-bit hash with which one of `there` rows is drawn, so that about `wanted` are, however many there are."""
    return -(1 << 63) + max(0, min((1 << 64) * wanted // max(1, there), 1 << 64) - 1)


def share(wanted: int, there: int, *of: str) -> Column:
    """A filter that about `wanted` of `there` rows pass, by a hash of these columns, the same ones each time; all if there are no more."""
    return F.xxhash64(*of, F.lit("sample")) <= F.lit(draw_limit(wanted, there)).cast("bigint")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df in one struct: an operator that keeps them there has its own names for itself."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(name)


def unpacked(df: DataFrame, name: str = "row", **changed: Column) -> list[Column]:
    """The columns in that struct, some of them changed. df: where they come from."""
    return [changed[c].alias(c) if c in changed else F.col(f"{name}.`{c}`") for c in df.columns]


def lookup(rows: DataFrame, of: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The rows whose key is in `of` (a row a key), with its other columns but count: how many of the rows have that key, in all `total`.

    Keys of a thousandth of the rows or more, of which there are at most 1,000, are broadcast, so that no task gets all rows of one
    key; the others are joined. `of` is read twice: it is to be a written table.
    """
    rest, floor = [c for c in of.columns if c not in (key, count)], max(1000, total // 1000)
    part = lambda where, k, v: of.filter(where).select(F.col(key).alias(k), F.struct(*rest).alias(v))
    found = rows.join(F.broadcast(part(F.col(count) >= floor, "f_key", "f_of")), F.col(key) == F.col("f_key"), "left")
    found = found.join(part(F.col(count) < floor, "r_key", "r_of"), F.when(F.col("f_key").isNull(), F.col(key)) == F.col("r_key"), "left")
    found = found.filter("f_key is not null or r_key is not null")
    return found.select(*rows.columns, *(F.coalesce(F.col("f_of")[c], F.col("r_of")[c]).alias(c) for c in rest))


def forest(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Node to smallest node of its component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = (p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    found = forest(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["node", "component"])


def components(edges: DataFrame, scratch: Scratch, local_edges: int = 1_000_000, name: str = "cc") -> DataFrame:
    """Connected components of an undirected graph.

    edges: two bigint columns, rows with a null or a loop count for nothing. Returns (node, component): the smallest node
    reachable, for each node that has an edge. While more than local_edges edges are left, every node merges into the
    neighbour (or itself) of lowest random priority, so that a round keeps a bounded share of the nodes whatever the graph's
    shape; the rest, of bounded size, is finished by union-find in one executor task.
    """
    a, b = edges.columns[:2]
    now = scratch.table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), f"{name}-0")
    maps: list[DataFrame] = []
    while now.count() > local_edges:
        k = len(maps) + 1
        both = now.union(now.select("b", "a"))
        rank = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("r"), F.col(c).alias("n"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["n"].alias("m"))
        maps.append(step := scratch.table(least, f"{name}-map{k}"))
        left = now.join(step.withColumnsRenamed({"m": "x"}), "a").select("b", "x")
        moved = scratch.table(left, f"{name}-half{k}").join(step.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        now = scratch.table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), f"{name}-{k}")
    done = scratch.table(now.repartition(1).mapInArrow(_local, "node bigint, component bigint"), f"{name}-local")
    for k in range(len(maps) - 1, -1, -1):
        up = maps[k].join(done.select(F.col("node").alias("m"), "component"), "m", "left")
        done = scratch.table(up.select(F.col("a").alias("node"), F.coalesce("component", "m").alias("component")), f"{name}-up{k}")
    if maps:
        least = done.groupBy("component").agg(F.min("node").alias("first"))
        done = scratch.table(done.join(scratch.table(least, f"{name}-least"), "component").select("node", F.col("first").alias("component")), f"{name}-named")
    return done
