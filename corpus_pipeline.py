"""From raw documents to packed training sequences: STAGES, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stylograph.llm import packing, passages, quality, secrets, simhash
from stylograph.llm.common import Scratch, packed, table, unpacked

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _with_text(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of documents, packed beside it, with a new text and its length."""
    return unpacked(docs, text=text, n_chars=F.length(text).cast("long"))


#: Scratch tables of the stages of the run that this thread is in; outside a run they go with the application.
_open: ContextVar[list[Scratch] | None] = ContextVar("open", default=None)


def _scratch(spark: SparkSession, name: str) -> Scratch:
    made = Scratch(spark, name)
    if (held := _open.get()) is not None:
        held.append(made)
    return made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with all columns as they are, whatever their names. Null texts have no word and go. An empty table stays empty."""
    read = docs.select(packed(docs), "text", *(["lang"] if "lang" in docs.columns else []))
    # a value that isn't a function of the row keeps the filter above the verdict, which is then computed once
    judged = quality.quality(read).withColumn("judged", F.col("kept") & (F.monotonically_increasing_id() >= 0))
    return judged.filter("judged").select(*unpacked(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row of the smallest (doc_id, text hash), rows without doc_id last; one row of those that repeat both.

    Rows are told apart by doc_id and text, so of a doc_id with several texts each is kept or goes with its own component. A null text
    counts as empty. All columns stay as they are; an empty table stays empty; texts of any length are taken whole.
    """
    found = simhash.simhash(docs, _scratch(spark, "near"))
    rows = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("f_doc"), F.col("f.text_hash").alias("f_hash"), F.col("f.n").alias("n"))
    repeated = not first.filter("n > 1").isEmpty()
    read = docs.select(packed(docs), "doc_id", F.xxhash64("text").alias("hash"))
    kept = read.join(first, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("hash") == F.col("f_hash")), "left_semi")
    return (kept.dropDuplicates(["doc_id", "hash"]) if repeated else kept).select(*unpacked(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; paragraphs that repeat an earlier one, exactly or nearly, and repeated passages are cut out of text.

    Rows that share a doc_id, or have none, are told apart by their texts. Texts of any length are taken whole, null ones stay null;
    all columns but text and n_chars stay as they are.
    """
    cut = passages.without(docs, passages.repeats(docs, _scratch(spark, "passages")))
    return cut.select(packed(cut), "text").select(*_with_text(docs, F.col("text")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what the scan finds is masked in text. Null texts stay null, texts of any length are scanned whole; all columns but text
    and n_chars stay as they are, whatever their names."""
    found = secrets.secrets(docs.select(packed(docs), "text")).withColumn("masked", secrets.redacted(F.col("text"), F.col("spans")))
    return found.select(*_with_text(docs, F.col("masked")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 tokens. A null text counts as empty, and every row has its pieces."""
    return packing.pack(docs, _scratch(spark, "packing"), TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: Connected components and token ids can't be said in SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote beside its result, and the stage before, is dropped once that is written, also where a stage fails."""
    kept, held = Scratch(spark, "pipeline"), []
    docs = table(spark, sf_dir, "documents")
    before = _open.set(held)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = kept.table(stage(spark, docs, sf_dir), f"stage{k}")
            while held:
                held.pop().close()
            if k:
                kept.drop(f"stage{k - 1}")
    except BaseException:
        kept.close()
        raise
    finally:
        _open.reset(before)
        while held:
            held.pop().close()
    return docs
