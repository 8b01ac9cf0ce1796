"""The queries that apply each operator to the driver's tables, and their SQL where DuckDB can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, automaton, codebooks, language, media, metric, packing, passages, quality, secrets, simhash, toxicity, warc
from .common import Scratch, table


def _remainder(of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(-1))


def op2_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = _remainder(4) == 2
    model = toxicity.fit(docs.filter(~held), labels.filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = _remainder(5) == 0
    out = language.predict(docs, language.fit(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_langs"))


def op6_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.documents(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", F.size("layout").alias("n_parts"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its ordered sequence, with the figure of the document of its number: captions before or after, payloads by digest.

    Payloads are the documents' texts; those of every third document are in no store, so their references stay unresolved.
    """
    scratch = Scratch(spark, "pages")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("caption"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.select("doc_id", "caption", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("n_bytes"))
    image, below = F.concat(F.lit(f'<img src="{media.SCHEME}'), F.col("digest"), F.lit('">')), F.concat(F.lit("<figcaption>"), F.col("caption"), F.lit("</figcaption>"))
    figure = F.concat(F.lit("<figure>"), F.when(F.col("doc_id") % 2 == 0, F.concat(below, image)).otherwise(F.concat(image, below)), F.lit("</figure>"))
    pages = table(spark, sf_dir, "pages").join(known, F.col("page_id") == F.col("doc_id"), "left").select("page_id", F.concat(F.coalesce("html", F.lit("")), F.coalesce(figure, F.lit(""))).alias("html"))
    store = known.filter("doc_id % 3 > 0").groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"))
    out = media.interleaved(scratch.table(media.sequences(pages, "page_id", "html"), "parsed"), store, scratch)
    shown = F.filter("parts", lambda p: (p["kind"] == "media") & (F.length(p["digest"]) == 64))
    return out.select(
        F.col("id").alias("page_id"), F.size("parts").alias("n_parts"), F.size(shown).alias("n_media"), F.sha2(F.to_json("parts"), 256).alias("sequence_sha256"), F.size(F.filter(shown, lambda p: p["payload"].isNotNull())).alias("n_resolved"),
        F.get(shown, F.lit(0))["payload"]["n_bytes"].cast("long").alias("n_bytes"), F.get(shown, F.lit(0))["caption"].alias("caption"),
    )


def op7_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op7")
    warc.write(warc.revisits(table(spark, sf_dir, "pages"), scratch), scratch.path("archives"))
    found = warc.read(spark, scratch.path("archives"))
    # digests are made where a payload is read, so that assembly moves none
    light = found.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "fields": F.when(F.col("type") == "metadata", F.col("payload").cast("string"))}).drop("payload")
    rows = warc.assemble(light).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    main, again = F.col("response"), F.col("response.type") == "revisit"
    return rows.select(
        F.regexp_extract("metadata.fields", "page_id: (-?[0-9]+)", 1).try_cast("long").alias("page_id"),
        F.when(again, main["http_length"]).otherwise(main["n"]).alias("payload_bytes"),
        F.when(again, F.regexp_replace(main["digest"], "^sha1:", "")).otherwise(main["sha1"]).alias("payload_digest"),
        main["type"].alias("record_type"),
        warc.page_of(main["refers_to"]).alias("refers_to"),
    )


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), Scratch(spark, "op8"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality.quality(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = secrets.listed(F.col("spans"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.listed(F.col("base_spans")), 256).alias("base_sha256"), spans.alias("spans"))


def op11_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op11"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op12"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op2_toxicity_pu": op2_toxicity_pu,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_language_mixture": op4_language_mixture,
    "op5_secret_scans": op5_secret_scans,
    "op6_media_sequences": op6_media_sequences,
    "op7_warc_captures": op7_warc_captures,
    "op8_mixture_packing": op8_mixture_packing,
    "op9_quality_rules": op9_quality_rules,
    "op11_metric_range_join": op11_metric_range_join,
    "op12_filter_audit": op12_filter_audit,
    "op13_vector_codes": op13_vector_codes,
    "media_page_sequences": page_sequences,
}
ORACLES: dict[str, str] = {
    "op7_warc_captures": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
        SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN m.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN m.top <> p.page_id THEN m.top END AS refers_to
        FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000
    """,
    "op11_metric_range_join": metric.sql(),
    "op12_filter_audit": audit.sql(),
    "op13_vector_codes": codebooks.sql(),
}
