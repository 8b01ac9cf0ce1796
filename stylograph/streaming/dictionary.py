"""An n-gram dictionary of an endless stream of texts, of bounded size, with a bound of its error for each entry.

Each batch's counts are merged with the table before it. Where an order then has more than `keep` n-grams, it is pruned to those
counted more often than the count that reaches `keep`. An n-gram that is absent has been seen at most `floor` times, the largest
possible count among all that were pruned; one that enters later starts with that as its error. So

    cnt <= true count <= cnt + err     for every entry,     true count <= floor     for every other n-gram,

and as long as nothing has been pruned all errors are 0 and the counts are those of a batch. Tables are numbered by batch: a batch that
is tried again reads the same table before it and replaces its own, so a restart counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import ngram_counts
from ..sources import files

SCHEMA = "n int, ngram string, cnt bigint, err bigint"  # a row whose ngram is null holds an order's floor


def merged(before: DataFrame, counts: DataFrame, keep: int, save) -> DataFrame:
    """The table after a batch. counts: n, ngram, cnt; save: writes a table and reads it again, for it is used three times."""
    floors = before.filter("ngram is null").select(F.col("n").alias("n_"), F.col("err").alias("floor"))  # a row an order
    entries = before.filter("ngram is not null").unionByName(counts.select("n", "ngram", "cnt", F.lit(None).cast("bigint").alias("err")))
    # an entry that was there keeps its error, a new one gets the floor
    sums = entries.groupBy("n", "ngram").agg(F.sum("cnt").alias("cnt"), F.max("err").alias("err"))
    now = save(sums.join(F.broadcast(floors), F.col("n") == F.col("n_"), "left").select("n", "ngram", "cnt", F.coalesce("err", "floor", F.lit(0)).cast("bigint").alias("err"), F.coalesce("floor", F.lit(0)).cast("bigint").alias("floor")))
    by = now.groupBy("n", "cnt").agg(F.count("*").alias("types"))
    upto = by.withColumn("upto", F.sum("types").over(Window.partitionBy("n").orderBy(F.desc("cnt"))))  # a row a count: few, as counts repeat
    least = upto.filter(F.col("upto") > keep).groupBy(F.col("n").alias("n_")).agg(F.max("cnt").alias("least"))  # none under the bound
    marked = now.join(F.broadcast(least), F.col("n") == F.col("n_"), "left")
    stays = F.col("least").isNull() | (F.col("cnt") > F.col("least"))
    raised = marked.groupBy("n").agg(F.greatest(F.max("floor"), F.coalesce(F.max(F.when(~stays, F.col("cnt") + F.col("err"))), F.lit(0))).alias("err"))
    quiet = floors.join(raised, F.col("n") == F.col("n_"), "left_anti").select(F.col("n_").alias("n"), F.col("floor").alias("err"))
    rows = raised.unionByName(quiet).select("n", F.lit(None).cast("string").alias("ngram"), F.lit(0).cast("bigint").alias("cnt"), "err")
    return marked.filter(stays).select("n", "ngram", "cnt", "err").unionByName(rows)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished tables."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = (x.getPath().getName() for x in store.listStatus(folder))
    return sorted(k for k in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if files.exists(spark, f"{path}/batch={k}/_SUCCESS"))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _table(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    return spark.createDataFrame([], SCHEMA) if version is None else spark.read.schema(SCHEMA).parquet(f"{path}/batch={version}")


def start(texts: DataFrame, path: str, checkpoint: str, keep: int = 500_000, orders: tuple[int, ...] = (2, 3, 4), min_words: int = 3, spill: bool = False, **trigger) -> StreamingQuery:
    """Starts counting a stream of text into tables under path. trigger: as for writeStream.trigger, by default all that is there.

    spill: what a batch prunes is written beside the table, which stays bounded; exact() adds it up again.
    """

    def write(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in _versions(spark, path) if v < k]

        def save(df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/sums={k}")
            return spark.read.schema(df.schema).parquet(f"{path}/sums={k}")

        out = merged(_table(spark, path, earlier[-1] if earlier else None), ngram_counts(batch, orders=orders, min_words=min_words), keep, save)
        if spill:  # before the table, whose success mark ends the batch
            stays = out.filter("ngram is not null").select("n", "ngram")
            sums = spark.read.parquet(f"{path}/sums={k}").select("n", "ngram", "cnt")
            sums.join(stays, ["n", "ngram"], "left_anti").write.mode("overwrite").parquet(f"{path}/pruned={k}")
        out.write.mode("overwrite").parquet(f"{path}/batch={k}")
        _delete(spark, f"{path}/sums={k}")
        for v in earlier[:-1]:  # the one before is kept: this batch may be tried again
            _delete(spark, f"{path}/batch={v}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """n, ngram, cnt, err of the latest table."""
    found = _versions(spark, path)
    return _table(spark, path, found[-1] if found else None).filter("ngram is not null")


def exact(spark: SparkSession, path: str) -> DataFrame:
    """n, ngram, cnt, err (0) of every n-gram seen: the latest table, and all that was pruned before (start with spill)."""
    out = current(spark, path).select("n", "ngram", "cnt")
    for k in _versions_seen(spark, path):
        out = out.unionByName(spark.read.schema("n int, ngram string, cnt bigint").parquet(f"{path}/pruned={k}"))
    return out.groupBy("n", "ngram").agg(F.sum("cnt").alias("cnt")).withColumn("err", F.lit(0).cast("bigint"))


def _versions_seen(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches up to the latest table, those whose tables are gone too."""
    found = _versions(spark, path)
    return [k for k in range(found[-1] + 1) if files.exists(spark, f"{path}/pruned={k}/_SUCCESS")] if found else []


def floors(spark: SparkSession, path: str) -> DataFrame:
    """n, floor: how often an n-gram that isn't in the table may have been seen."""
    found = _versions(spark, path)
    return _table(spark, path, found[-1] if found else None).filter("ngram is null").select("n", F.col("err").alias("floor"))
