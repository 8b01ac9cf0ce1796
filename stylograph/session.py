"""Sessions, and tables that cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "stylograph", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="stylograph-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, on one machine only, a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return place or _own_dir()


def dropped_at_exit(spark: SparkSession, path: str) -> None:
    """Makes a folder that goes when the driver's JVM ends, if nobody drops it before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    store.deleteOnExit(folder)


class Stage:
    """Written tables in the shared folder: later steps read them, whatever happens to the executors that made them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._used = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", Counter()
        dropped_at_exit(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written. A name that is used again gets a table of its own, as the earlier one may still be read."""
        self._used[name] += 1
        place = self.path(name if self._used[name] == 1 else f"{name}-again{self._used[name]}")
        df.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)
