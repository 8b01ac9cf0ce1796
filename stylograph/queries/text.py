"""Normalisation, tokenizers, labels, scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import citations, corpus, report, style


#: Tables under this size may be a single row group, which one task reads: their rows are dealt out. Bytes of a larger table's file a task.
SMALL, SHARE = 64 << 20, 16 << 20


def docs(spark, d):
    """The documents. A row group is read by one task, so rows are dealt out unless they lie evenly: Spark cuts a file by its bytes."""
    df = spark.read.parquet(f"{d}/documents.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(spark.sparkContext.defaultParallelism, size // SHARE)
    if size >= SMALL:
        rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # a number a task, by the footers
        if max(rows, default=0) * spark.sparkContext.defaultParallelism <= 2 * sum(rows):
            return df
    return df.repartition(tasks)


def _project(**columns):
    """A query that projects columns of documents, beside doc_id."""
    return lambda spark, d: docs(spark, d).select("doc_id", *(c().alias(k) for k, c in columns.items()))


T = lambda: F.col("text")
#: Attacked text, the same in both engines: look-alikes and zero-width marks put in by rule.
SPOILED = lambda: F.concat(F.translate(F.col("text"), "aeo", "аео"), F.lit("​"), F.lit(" end  of ,text"))
SPOILED_SQL = "translate(text, 'aeo', 'аео') || chr(8203) || ' end  of ,text'"
ZW = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in L.ZERO_WIDTH) + "]"
FOLD = f"translate(%s, '{L.CONFUSABLE_FROM}', '{L.CONFUSABLE_TO}')"
LIKE = "[" + L.CONFUSABLE_FROM + "]"


def _case(families, column, default):
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{k}') THEN '{v}'" for k, v in families) + f" ELSE {default} END"


LABEL = "CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'human_a' WHEN 1 THEN 'OpenAI-x' WHEN 2 THEN 'claude-2' WHEN 3 THEN 'PaLM' WHEN 4 THEN 'xai' WHEN 5 THEN 'mixtral' WHEN 6 THEN 'DeepSeek' WHEN 7 THEN 'gpt-4' ELSE 'llama' END"
BIB = "concat(text, '\nAs (Smith, 2019) and Doe (2021) say.\nReferences\nSmith, J., & Brown, B. (2019). A study of number ', CAST(doc_id AS VARCHAR), '. doi:10.1234/x', CAST(doc_id AS VARCHAR), '\nDoe, A. (1850). An old work.\n')"
BIB_SPARK = BIB.replace("VARCHAR", "STRING")


def _bib(spark, d):
    return docs(spark, d).withColumn("text", F.expr(BIB_SPARK))


#: The measure is defined on the first 3,000 characters.
FK_CTE = r"""WITH d AS (SELECT doc_id, substr(coalesce(text, ''), 1, 3000) AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z'']+') AS w,
            greatest(1, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: regexp_matches(s, '\S')))) AS ns FROM d),
            y AS (SELECT *, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN regexp_matches(x, '[^l]e$') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))) AS sy FROM w)"""
#: The same of whole texts.
FK_WHOLE = FK_CTE.replace("substr(coalesce(text, ''), 1, 3000)", "coalesce(text, '')")
FK_VALUE = "CASE WHEN len(w) = 0 THEN 0.0 ELSE round(greatest(-5.0, least(30.0, CAST(0.39 AS DOUBLE) * len(w) / ns + CAST(11.8 AS DOUBLE) * sy / len(w) - CAST(15.59 AS DOUBLE))), 1) END"

ALL = {
    "flt_nonempty": (lambda s, d: docs(s, d).filter(F.col("text").rlike(r"(?U)\S")).select("doc_id"), r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')"),
    "flt_minlen_words": (
        _project(n_ws=lambda: F.size(C.tok_ws(T())).cast("long"), long_enough=lambda: F.size(C.tok_ws(T())) >= 20),
        r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_ws, len(regexp_extract_all(text, '\S+')) >= 20 AS long_enough FROM documents",
    ),
    "flt_minlen_chars": (_project(long_enough=lambda: F.length(C.trimmed(T())) >= 20), r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AS long_enough FROM documents"),
    "tok_counts": (
        _project(n_word=lambda: F.size(C.tok_word(T())).cast("long"), n_latin=lambda: F.size(C.tok_latin(T())).cast("long"), n_sent=lambda: F.size(C.sent_punct(T())).cast("long"), n_par=lambda: F.size(C.paragraphs(T())).cast("long")),
        r"""SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS BIGINT) AS n_word, CAST(len(regexp_extract_all(text, '[A-Za-z'']+')) AS BIGINT) AS n_latin,
            CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS BIGINT) AS n_sent,
            CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda s: regexp_matches(s, '\S'))) AS BIGINT) AS n_par FROM documents""",
    ),
    "prj_label_v6": (_project(label=lambda: C.family(F.expr(LABEL), L.FAMILIES_V6, "Unknown AI")), f"SELECT doc_id, {_case(L.FAMILIES_V6, LABEL, chr(39) + 'Unknown AI' + chr(39))} AS label FROM documents"),
    "prj_label_v7": (
        lambda s, d: docs(s, d).select("doc_id", C.family(F.expr(LABEL), L.FAMILIES_V7).alias("label")).filter("label is not null"),
        f"SELECT doc_id, label FROM (SELECT doc_id, {_case(L.FAMILIES_V7, LABEL, 'NULL')} AS label FROM documents) WHERE label IS NOT NULL",
    ),
    "prj_label_id": (
        _project(v6=lambda: (F.array_position(F.array(*map(F.lit, L.LABELS_V6)), C.family(F.expr(LABEL), L.FAMILIES_V6)) - 1).cast("int"), v7=lambda: (F.array_position(F.array(*map(F.lit, L.LABELS_V7)), C.family(F.expr(LABEL), L.FAMILIES_V7)) - 1).cast("int")),
        f"SELECT doc_id, CAST(list_position({L.LABELS_V6}, {_case(L.FAMILIES_V6, LABEL, 'NULL')}) - 1 AS INT) AS v6, CAST(list_position({L.LABELS_V7}, {_case(L.FAMILIES_V7, LABEL, 'NULL')}) - 1 AS INT) AS v7 FROM documents",
    ),
    "prj_fk": (
        _project(fk=lambda: corpus.flesch_kincaid(T())),
        f"{FK_CTE} SELECT doc_id, {FK_VALUE} AS fk FROM y",
    ),
    # a grade that rounds to zero has no sign
    "prj_fk_prefix": (_project(prefixed=lambda: F.md5(F.format_string("[FK_SCORE: %.1f] %s", corpus.flesch_kincaid(T()), F.coalesce("text", F.lit(""))))), None),
    "prj_length_route": (
        _project(route=lambda: F.when(F.size(C.tok_latin(T())) < 60, "short").otherwise("long")),
        "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z'']+')) < 60 THEN 'short' ELSE 'long' END AS route FROM documents",
    ),
    "nrm_clean": (_project(clean=lambda: F.md5(C.clean(SPOILED()))), rf"SELECT doc_id, md5(regexp_replace(regexp_replace({SPOILED_SQL}, '\s{{2,}}', ' ', 'g'), '\s+([,.;:?!])', '\1', 'g')) AS clean FROM documents"),
    "nrm_hyphen": (
        _project(joined=lambda: F.md5(C.join_hyphens(F.regexp_replace(T(), " t", "-\nt")))),
        r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(text, ' t', '-' || chr(10) || 't'), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS joined FROM documents",
    ),
    "nrm_zero_width": (
        _project(bare=lambda: F.md5(C.strip_zero_width(SPOILED())), removed=lambda: (F.length(SPOILED()) - F.length(C.strip_zero_width(SPOILED()))).cast("long")),
        f"SELECT doc_id, md5(regexp_replace({SPOILED_SQL}, '{ZW}', '', 'g')) AS bare, CAST(length({SPOILED_SQL}) - length(regexp_replace({SPOILED_SQL}, '{ZW}', '', 'g')) AS BIGINT) AS removed FROM documents",
    ),
    "nrm_confusables": (
        _project(folded=lambda: F.md5(C.fold_confusables(SPOILED())), replaced=lambda: C.confusables(SPOILED()).cast("long")),
        f"SELECT doc_id, md5({FOLD % SPOILED_SQL}) AS folded, CAST(len(regexp_extract_all({SPOILED_SQL}, '{LIKE}')) AS BIGINT) AS replaced FROM documents",
    ),
    "nrm_tamper": (
        lambda s, d: docs(s, d).select("doc_id", C.tamper(SPOILED()).alias("t")).select("doc_id", F.col("t.replaced").cast("long").alias("replaced"), F.round("t.ratio", 6).alias("ratio"), "t.suspicious"),
        f"""WITH b AS (SELECT doc_id, regexp_replace({SPOILED_SQL}, '{ZW}', '', 'g') AS b FROM documents), c AS (SELECT doc_id, len(regexp_extract_all(b, '{LIKE}')) AS r, length(regexp_replace({FOLD % 'b'}, '[^A-Za-z]', '', 'g')) AS l FROM b)
            SELECT doc_id, CAST(r AS BIGINT) AS replaced, round(CASE WHEN l + r > 0 THEN r / (l + r) ELSE 0 END, 6) AS ratio, true AS suspicious FROM c""",
    ),
    "nrm_alnum": (_project(alnum=lambda: F.md5(citations.alnum(T()))), r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '^\s+|\s+$', '', 'g')) AS alnum FROM documents"),
    "nrm_canonical": (_project(canonical=lambda: F.md5(C.canonical(SPOILED()))), None),
    "fn_text_hash": (_project(text_hash=lambda: F.substring(F.sha2(T(), 256), 1, 16)), "SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash FROM documents"),
    "fn_punct_rates": (
        _project(commas=lambda: C.occurrences(T(), ",").cast("long"), dots=lambda: C.occurrences(T(), "...").cast("long"), dashes=lambda: (C.occurrences(T(), "—") + C.occurrences(T(), "–") + C.occurrences(T(), " - ")).cast("long")),
        "SELECT doc_id, CAST(length(text) - length(replace(text, ',', '')) AS BIGINT) AS commas, CAST((length(text) - length(replace(text, '...', ''))) / 3 AS BIGINT) AS dots, "
        "CAST(length(text) - length(replace(text, '—', '')) + length(text) - length(replace(text, '–', '')) + (length(text) - length(replace(text, ' - ', ''))) / 3 AS BIGINT) AS dashes FROM documents",
    ),
    "fn_pos_fallback": (_project(n_verb=lambda: F.size(F.filter(style.tags(T()), lambda t: t == "VERB")).cast("long"), n_det=lambda: F.size(F.filter(style.tags(T()), lambda t: t == "DET")).cast("long")), None),
    "tf_inline": (lambda s, d: _bib(s, d).select("doc_id", F.array_join(citations.inline(citations.split_bibliography(T())["body"]), "|").alias("cites")), None),
    "tf_apa": (
        lambda s, d: _bib(s, d).select("doc_id", F.explode(citations.references(T())).alias("r")).select("doc_id", "r.position", "r.year", "r.title", "r.doi"),
        None,
    ),
    "tf_doi": (lambda s, d: _bib(s, d).select("doc_id", F.regexp_extract("text", citations.DOI, 1).alias("doi")), "SELECT doc_id, '10.1234/x' || CAST(doc_id AS VARCHAR) AS doi FROM documents"),
    "agg_ref_features": (lambda s, d: _bib(s, d).select("doc_id", citations.features(T(), 2025).alias("f")).select("doc_id", "f.*"), None),
    "fn_author_block": (lambda s, d: docs(s, d).select("doc_id", F.array_join(citations.author_surnames(F.concat(F.lit("Smith, J. A., Brown, B., & "), F.col("source"), F.lit("ville, C."))), "|").alias("authors")), None),
    "fn_attr_sent": (lambda s, d: docs(s, d).select("doc_id", F.explode(report.sentence_scores(T(), F.lit(0.6))).alias("s")).select("doc_id", "s.position", F.round("s.score", 6).alias("score"), F.array_join("s.indicators", "|").alias("indicators")), None),
    "sink_json_report": (
        _project(json=lambda: report.report_json({"doc_id": F.col("doc_id"), "lang": F.col("lang"), "text_hash": F.substring(F.sha2(T(), 256), 1, 16)})),
        """SELECT doc_id, '{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '","text_hash":"' || substr(sha256(text), 1, 16) || '"}' AS json FROM documents""",
    ),
}
