"""Event-time operators over streams of events (event_id, user_id, ts, event_type, value), with bounded state.

State is kept until the watermark, the largest time seen less `late`, has passed it. Rows up to `late` behind count for sure; a row whose state
went before the batch that brings it is dropped. (In between, a row may still count: Spark judges lateness by the watermark of one batch before.)
Results are appended once, when the watermark has passed their window's end. Each function takes a batch table too and then gives what a stream
gives that drops nothing and whose time has gone on for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def marked(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, v: count and sum of value in overlapping windows."""
    out = marked(events, late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: a user's events with no pause of `gap` or more between them."""
    out = marked(events, late).filter("user_id is not null").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, *key: str, late: str = "10 minutes") -> DataFrame:
    """One row of each key, as long as copies come within `late` of each other. Of a batch: one row of each key."""
    key = key or ("event_id",)
    return marked(events, late).dropDuplicatesWithinWatermark(list(key)) if events.isStreaming else events.dropDuplicates(list(key))


def matched(left: DataFrame, right: DataFrame, on: str = "user_id", within: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Pairs of a left event and a right one of the same key up to `within` after it: on, left_id, right_id, left_ts, right_ts."""
    a = marked(left, late).select(F.col(on), F.col("event_id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = marked(right, late).select(F.col(on).alias("on_"), F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"))
    near = (F.col(on) == F.col("on_")) & (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("on_")


def read(spark, path: str, schema, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def write(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is final by now to a table, exactly once, also over restarts."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
