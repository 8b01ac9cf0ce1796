"""Streaming forms: n-gram counts of arriving texts, and time windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def ngram_stream(texts: DataFrame, path: str, checkpoint: str, orders: tuple[int, ...] = (2, 3, 4), min_words: int = 20):
    """Starts counting n-grams of a stream of text; each batch's own counts are written under path, by batch, so a retried batch
    replaces itself. counts_of() adds them up: exactly the counts of all texts, with no state but the files."""

    def write(batch: DataFrame, k: int) -> None:
        from ..operators.corpus import ngram_counts

        ngram_counts(batch, orders=orders, min_words=min_words).write.mode("overwrite").parquet(f"{path}/batch={k}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_of(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).groupBy("n", "ngram").agg(F.sum("cnt").alias("cnt"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


