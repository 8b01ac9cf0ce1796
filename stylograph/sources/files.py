"""Readers of corpora, and writers of results."""

from __future__ import annotations

import hashlib
import os
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..session import Stage


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files, .parquet, .json (an array or objects), .jsonl (lines); anything else is CSV with a header."""
    kind = path.rsplit("/", 1)[-1].rsplit(".", 1)
    end = kind[1].lower() if len(kind) == 2 else ""
    if end in ("", "parquet"):
        return spark.read.parquet(path)
    if end in ("json", "jsonl"):
        return spark.read.json(path, multiLine=end == "json")
    return read_csv(spark, path)


#: White space at the ends of values belongs to them.
KEPT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header. Nothing between two commas is null, a pair of quotes an empty text: a mark that no text has stands for null inside the reader."""
    return spark.read.options(**KEPT, multiLine=True, nullValue=uuid.uuid4().hex, emptyValue="").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that read_csv reads as it was: null is nothing, an empty text a pair of quotes."""
    df.write.options(**KEPT, nullValue="", emptyValue='""').csv(path)


def enough_words(text: Column, least: int = 20) -> Column:
    return F.size(C.tok_ws(text)) >= least


def dictionary_texts(spark: SparkSession, path: str, kind: str, column: str = "text", least: int = 20, max_rows: int | None = None) -> DataFrame:
    """text of at least `least` words, from csv, jsonl (bad lines skipped) or folder (each *.txt a text). List columns are flattened.

    max_rows keeps that many in the order of text, so that the choice doesn't depend on how files are split.
    """
    if kind == "csv":
        df = read_csv(spark, path).select(F.col(column).alias("text"))
    elif kind == "jsonl":
        df = spark.read.json(path, mode="DROPMALFORMED").select(F.col(column).alias("text"))
    elif kind == "folder":
        df = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("value").alias("text"))
        df = df.coalesce(8 * spark.sparkContext.defaultParallelism)  # a file counts as 4 MB at least, which makes a task of a few small ones
    else:
        raise ValueError(f"unknown kind {kind!r}")
    if df.schema["text"].dataType.typeName() == "array":
        df = df.select(F.explode("text").alias("text"))
    df = df.select(C.trimmed(F.col("text").cast("string")).alias("text")).filter(F.col("text").isNotNull()).filter(enough_words(F.col("text"), least))
    return df.orderBy("text").limit(max_rows) if max_rows is not None else df


def _put(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0):
                place = f"{folder}/part-{task:05d}-{k:09d}.txt"  # another attempt of the task has the same rows and names
                part = f"{folder}/.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write((text.as_py() or b"") + b"\n")
                os.replace(part, place)
                k += 1
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], names=["files"])

    return run


def write_texts(texts: DataFrame, path: str) -> None:
    """A folder with a file for each text. Tasks put their files in place, not the driver one by one; a folder a text would have to be listed alone.

    In a shared folder of the file system they are plain files: Spark's writer sets up a writer, a checksum and a rename for each.
    """
    spark = texts.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        texts.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
        return
    if store.exists(where):
        raise FileExistsError(path)
    store.mkdirs(where)
    texts.select(F.col(texts.columns[0]).cast("binary")).mapInArrow(_put(store.makeQualified(where).toUri().getPath()), "files long").agg(F.sum("files")).collect()


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def audit(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of the files under path, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def same_files(spark: SparkSession, a: str, b: str) -> bool:
    """Whether two folders hold the same files."""
    x, y = audit(spark, a), audit(spark, b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


COPIED = "name string, bytes bigint, sha256 string, status string, attempts int"
CHUNK = 16 << 20


def _digest(store: fs.FileSystem, path: str) -> str:
    found = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while part := f.read(CHUNK):
            found.update(part)
    return found.hexdigest()


def _copier(source: str, target: str, retries: int, by_size: bool):
    def one(name: str, size: int) -> tuple:
        here, a = fs.FileSystem.from_uri(source)
        there, b = fs.FileSystem.from_uri(target)
        a, b = f"{a}/{name}", f"{b}/{name}"
        has = there.get_file_info(b)
        same = has.is_file and has.size == size
        if same and by_size:
            return name, size, None, "kept", 0
        want = _digest(here, a)
        if same and _digest(there, b) == want:
            return name, size, want, "kept", 0
        for attempt in range(1, retries + 1):
            try:
                there.create_dir(b.rsplit("/", 1)[0], recursive=True)
                part = f"{b}.{uuid.uuid4().hex}.part"  # another attempt, also of a lost task, has a file of its own
                with here.open_input_stream(a) as f, there.open_output_stream(part) as out:
                    while block := f.read(CHUNK):
                        out.write(block)
                if _digest(there, part) == want:
                    there.move(part, b)
                    return name, size, want, "mended" if has.is_file else "copied", attempt
                there.delete_file(part)
            except OSError:
                if attempt == retries:
                    raise
            time.sleep(min(30, 2 ** (attempt - 1)))
        return name, size, want, "failed", retries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(n, k) for n, k in zip(batch.column("name").to_pylist(), batch.column("bytes").to_pylist(), strict=True)]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["name", "bytes", "sha256", "status", "attempts"])

    return run


def copy_verified(spark: SparkSession, source: str, target: str, stage: Stage, retries: int = 3, by_size: bool = False) -> DataFrame:
    """Copies the files under a folder, each in a task of its own, in blocks, whatever its size; a written manifest: name, bytes, sha256, status, attempts.

    status: kept (the target has it already), copied, mended (the target had something else), failed (its digest never came out right). A copy
    appears under its name once its digest is that of the source, so a lost task leaves nothing half-written in place. by_size: a file of the
    same size counts as the same unread (sha256 is then null). Empty files, which Spark's listing leaves out, aren't copied. source and target: URIs that pyarrow opens (file, hdfs, s3, gs).
    """
    root = source.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    bare = root.split("://", 1)[-1]
    named = listed.select(F.element_at(F.split("path", re.escape(bare) + "/", 2), 2).alias("name"), F.col("length").alias("bytes"))
    n = max(1, min(named.count(), 4 * spark.sparkContext.defaultParallelism))
    return stage.table(named.repartition(n, "name").mapInArrow(_copier(root, target.rstrip("/"), retries, by_size), COPIED), "manifest")


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """build(), written to path, unless it is there already (a finished write: it has its success mark)."""
    if not exists(spark, path.rstrip("/") + "/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ready(spark: SparkSession, paths: list[str]) -> dict[str, bool]:
    return {p: exists(spark, p) for p in paths}


def write_dictionary(counts: DataFrame, path: str) -> None:
    """n-gram counts, a folder for each order."""
    counts.write.mode("overwrite").partitionBy("n").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str, scalars: list[str]) -> DataFrame:
    """Stored profiles, an object a line: author_id, schema_version, adaptive_threshold, vectors and scalars.

    What an earlier version lacks gets its default (L.PROFILE_DEFAULTS); other keys are left out, other missing values are null.
    """
    text, number, vector = ("author_id", "schema_version", "pos_bigrams_source"), ("adaptive_threshold", *scalars), ("feature_mean", "feature_std", "feature_vector")
    schema = ", ".join([*(f"{k} string" for k in text), *(f"{k} double" for k in number), *(f"{k} array<double>" for k in vector)])
    return spark.read.schema(schema).json(path).fillna({k: v for k, v in L.PROFILE_DEFAULTS.items() if k in (*text, *number)})


def write_artifacts(tables: dict[str, DataFrame], path: str) -> None:
    """Small result tables (calibration, thresholds, split sizes, evaluation), each as JSON lines in a folder of its name."""
    for name, df in tables.items():
        write_json(df, f"{path}/{name}")


def read_artifact(like: DataFrame, path: str, name: str) -> DataFrame:
    """A table of write_artifacts, with the columns of `like`."""
    return like.sparkSession.read.schema(like.schema).json(f"{path}/{name}")
