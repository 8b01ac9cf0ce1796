"""The rest of the inventory: single counts, joins, ranks, levels, attacks, sources."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import citations, corpus, ensemble, features, report, risk, selection, style, watermark
from ..session import Stage
from ..sources import files
from .ensemble import S, scores
from .features import COUNTS, GRAMS, SENT, SERIES, SERIES_SQL, WORD, WS, _in
from .text import BIB_SPARK, SPOILED, SPOILED_SQL, _project, docs

W = "w AS (SELECT doc_id, text, lower(text) AS low, " + WORD + " AS w FROM documents)"
TEXT_ = lambda: F.col("text")
LOW = lambda: F.lower("text")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


def _ratio(words):
    return _project(ratio=lambda: F.round(C.share_in(C.tok_word(TEXT_()), words) / F.greatest(F.size(C.tok_word(TEXT_())), F.lit(1)), 6)), f"WITH {W} SELECT doc_id, round(len(list_filter(w, lambda x: x IN {_in(words)})) / greatest(len(w), 1), 6) AS ratio FROM w"


def _ngram_rep(spark, d):
    w = docs(spark, d).select("doc_id", C.tok_word(TEXT_()).alias("w")).select("doc_id", "w", C.run_counts(C.ngrams(F.col("w"), 4)).alias("c"))
    return w.select("doc_id", F.round(F.when(F.size("w") >= 4, F.size(F.filter("c", lambda x: x > 1)) / (F.size("w") - 3)).otherwise(0.0), 6).alias("rate"))


def _sentences(spark, d):
    s = docs(spark, d).select("doc_id", F.transform(C.sent_punct(TEXT_()), lambda x: F.size(C.tok_ws(x))).alias("n"))
    return s.select("doc_id", F.round(C.mean(F.col("n")), 6).alias("mean"), F.round(C.variance(F.col("n")), 6).alias("var"), F.round(F.sqrt(C.variance(F.col("n"), 1)), 6).alias("std"), F.round(style.burstiness(F.col("n")), 6).alias("burstiness"))


SENT_SQL = f"""WITH s AS (SELECT doc_id, list_transform({SENT % 'text'}, lambda x: len({WS % 'x'})) AS n FROM documents), m AS (SELECT doc_id, len(n) AS k, coalesce(list_avg(n), 0) AS m, coalesce(list_aggregate(n, 'var_pop'), 0) AS v, coalesce(list_aggregate(n, 'stddev_samp'), 0) AS s FROM s)
SELECT doc_id, round(m, 6) AS mean, round(v, 6) AS var, round(s, 6) AS std, round(CASE WHEN k < 3 THEN 0 ELSE (sqrt(v) - m) / (sqrt(v) + m) END, 6) AS burstiness FROM m"""


def _top_common(spark, d):
    """The 10 most frequent bigrams of each source; ties by bigram."""
    each = docs(spark, d).select("source", F.explode(C.ngrams(C.tok_word(TEXT_()), 2)).alias("g")).groupBy("source", "g").agg(F.count("*").alias("n"))
    order = (F.desc("n"), F.asc("g"))
    some = each.withColumn("r", F.row_number().over(Window.partitionBy("source", F.pmod(F.xxhash64("g"), F.lit(64))).orderBy(*order))).filter("r <= 10")
    return some.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter("r <= 10").select("source", F.col("r").cast("long").alias("r"), "g", "n")


def _rank_avg(spark, d):
    cut = scores(spark, d).groupBy("p").agg(F.count("*").alias("c")).withColumn("cell", F.floor(F.col("p") * 1024))
    before = F.broadcast(cut.groupBy("cell").agg(F.sum("c").alias("k")).select(F.col("cell").alias("c_"), F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b")))  # 1,025 cells
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("cell").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(before, F.col("cell") == F.col("c_")).select(F.round("p", 6).alias("p"), (F.col("b") + inside + (F.col("c") + 1) / 2).alias("rank"))


def _lsh(spark, d):
    """Bands that two or more documents share, and how many do."""
    m = corpus.minhash(docs(spark, d)).select("doc_id", F.explode(corpus.band_keys(F.col("sig"))).alias("key"))
    return m.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").groupBy("n").agg(F.count("*").alias("bands"))


def _ngram_lookup(spark, d):
    dictionary = Stage(spark, "lookup").table(corpus.ngram_dictionary(docs(spark, d), orders=(2,)), "top")
    own = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(C.ngrams(C.tok_word(TEXT_()), 2)).alias("ngram"))
    return own.join(dictionary.select("ngram", "cnt"), "ngram", "left").groupBy("item_id").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("total"), F.count("cnt").alias("known"))


def _copy_verify(spark, d):
    """The documents, read from a verified copy of their files."""
    stage = Stage(spark, "copy")
    docs(spark, d).select("doc_id", "text").write.parquet(stage.path("a"))
    manifest = files.copy_verified(spark, stage.path("a"), stage.path("b"), stage)
    if not manifest.filter("status <> 'copied'").isEmpty() or not files.same_files(spark, stage.path("a"), stage.path("b")):
        raise ValueError("the copy differs")
    return spark.read.parquet(stage.path("b")).select("doc_id", F.md5("text").alias("text"))


def _cached(spark, d):
    path = Stage(spark, "cache").path("t")
    files.cached(spark, path, lambda: docs(spark, d).select("doc_id", "lang"))
    return files.cached(spark, path, lambda: docs(spark, d).select("doc_id", "lang").limit(0))


def _profile_json(spark, d):
    path = Stage(spark, "profile").path("p")
    c = style.centroids(style.stylometric(docs(spark, d).select("source", "text")).withColumn("v", F.slice("style_vector", 1, 18)), "source", "v", 18)
    files.write_json(c, path)
    return spark.read.schema(c.schema).json(path).select("author", "n", F.round(F.get("mean", F.lit(1)), 4).alias("word_length"))


def _vector(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return e


def _median(spark, d):
    q = selection.quantiles(docs(spark, d).select(F.col("lang").alias("g"), F.col("n_chars").alias("v")), [0.5, 0.99], Stage(spark, "median"))
    return q.groupBy(F.col("g").alias("lang")).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(k) for k, p in (("median", 0.5), ("q99", 0.99))))


def _cosine(spark, d):
    e = _vector(spark, d)
    c = style.centroids(e, "label", "v", 64).select(F.col("author").alias("l"), "mean")
    return e.join(F.broadcast(c), F.col("label") == F.col("l")).select("vec_id", F.round(style.cosine(F.col("v"), F.col("mean")), 5).alias("cosine"))


def _attacked(kind):
    return lambda s, d: docs(s, d).select("doc_id", F.md5(corpus.attack(TEXT_(), F.col("doc_id"), kind)).alias("attacked"), (F.length(corpus.attack(TEXT_(), F.col("doc_id"), kind)) - F.length("text")).alias("grown"))


def _aug_v7(spark, d):
    return docs(spark, d).select("doc_id", F.md5(corpus.augment_v7(TEXT_(), F.col("doc_id"))).alias("augmented"))


def _aug_v6(spark, d):
    return docs(spark, d).select("doc_id", F.md5(corpus.augment_v6(TEXT_(), F.col("doc_id"))).alias("augmented"))


def _hybrid(spark, d):
    """Windows of 100 words at stride 40 with their burstiness."""
    w = docs(spark, d).select("doc_id", F.explode(style.word_windows(TEXT_(), 100, 40)).alias("x"))
    return w.select("doc_id", F.col("x.offset").cast("long").alias("start"), F.round(style.burstiness(F.transform(C.sent_punct(F.array_join("x.words", " ")), lambda s: F.size(C.tok_ws(s)))), 6).alias("burstiness"))


def _jaccard(spark, d):
    return features.hallucination(docs(spark, d)).select("doc_id", *(F.round(f"hallucination.{k}", 6).alias(k) for k in ("avg_jaccard_similarity", "min_jaccard_similarity", "max_semantic_drop", "disconnected_sentences_ratio")))


def _works(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("c_title"), F.array(F.lower("p_brand")).alias("c_authors"), (F.lit(1990) + F.col("p_size")).cast("int").alias("c_year"), F.col("p_type").alias("c_journal"))


def _candidates(spark, d):
    refs = spark.read.parquet(f"{d}/part.parquet").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("ref_id"), F.concat(F.col("p_name"), F.lit(" study")).alias("title"), F.array(F.lower("p_brand")).alias("authors"), (F.lit(1990) + F.col("p_size")).cast("int").alias("year"), F.col("p_type").alias("journal"))
    found = citations.confidence(citations.candidates(refs, _works(spark, d)))
    return found.groupBy("ref_id").agg(F.round(F.max("confidence"), 4).alias("confidence"), F.max_by("work_id", F.struct("confidence", -F.col("work_id"))).alias("work_id"))


#: The largest inner peak of the autocorrelation.
AUTOCORR = f"""WITH v AS (SELECT doc_id, {SERIES_SQL} AS v FROM documents), m AS (SELECT doc_id, list_transform(v, lambda x: x - list_avg(v)) AS x FROM v), r AS (SELECT doc_id, list_transform(range(0, 21), lambda k: list_sum(list_transform(range(1, 22 - k), lambda i: x[i] * x[i + k]))) AS r FROM m),
    n AS (SELECT doc_id, list_transform(r, lambda y: round(y / r[1], 9)) AS r, abs(r[1]) < 1e-12 AS flat FROM r) SELECT doc_id, CASE WHEN flat THEN 0 ELSE round(coalesce(list_max(list_filter(r, lambda y, i: i > 1 AND i < 21 AND y > r[i - 1] AND y > r[i + 1])), 0), 5) END AS peak FROM n"""
V = "v AS (SELECT doc_id, " + SERIES_SQL + " AS v FROM documents)"
_v = lambda spark, d: docs(spark, d).select("doc_id", F.expr(SERIES).alias("v"))

ALL = {
    "src_copy_verify": (_copy_verify, "SELECT doc_id, md5(text) AS text FROM documents"),
    "cache_stage": (_cached, "SELECT doc_id, lang FROM documents"),
    "sink_dataset": (lambda s, d: Stage(s, "sink").table(docs(s, d).select("doc_id", "n_chars"), "t"), "SELECT doc_id, n_chars FROM documents"),
    "sink_profile_json": (_profile_json, None),
    "sink_png_charts": (lambda s, d: docs(s, d).select("doc_id", F.explode(F.slice(report.word_scores(TEXT_(), F.lit(0.5)), 1, 200)).alias("w")).select("doc_id", "w.position", F.round("w.score", 6).alias("score")), None),
    "nrm_nfkc": (_project(n=lambda: F.length(nfkc(F.concat(TEXT_(), F.lit("ﬁ①")))).cast("long")), "SELECT doc_id, CAST(length(text) + 3 AS BIGINT) AS n FROM documents WHERE nfc_normalize(text) = text"),
    "nrm_zero_width_attr": (_project(n=lambda: F.length(F.translate(SPOILED(), L.ZERO_WIDTH_ATTRIBUTION, "")).cast("long")), f"SELECT doc_id, CAST(length(replace({SPOILED_SQL}, chr(8203), '')) AS BIGINT) AS n FROM documents"),
    "prj_column_prune": (lambda s, d: docs(s, d).select("doc_id"), "SELECT doc_id FROM documents"),
    "jn_ngram_lookup": (
        _ngram_lookup,
        f"""WITH d AS (SELECT {WORD} AS w FROM documents WHERE len({WS % 'text'}) >= 20), g AS (SELECT unnest({GRAMS % dict(w='w', n=2)}) AS ngram FROM d), c AS (SELECT ngram, count(*) AS cnt FROM g GROUP BY 1),
            r AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cnt DESC, ngram) AS r FROM c) WHERE r <= 100000), b AS (SELECT item_id, {WORD} AS w FROM benchmark), e AS (SELECT item_id, unnest({GRAMS % dict(w='w', n=2)}) AS ngram FROM b)
            SELECT item_id, CAST(sum(coalesce(cnt, 0)) AS BIGINT) AS total, count(cnt) AS known FROM e LEFT JOIN r USING (ngram) GROUP BY item_id""",
    ),
    "jn_lsh_band": (_lsh, None),
    "jn_test_labels": (lambda s, d: scores(s, d).select("doc_id", "y", F.round("p", 6).alias("p")), f"WITH {S} SELECT doc_id, y, round(p, 6) AS p FROM s"),
    "jn_author_sets": (
        lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.array((F.col("o_custkey") % 3).cast("int"), F.lit(1), F.lit(2)).alias("a"), F.array((F.col("o_orderkey") % 4).cast("int"), F.lit(2)).alias("b")).select("o_orderkey", F.size(F.array_intersect("a", "b")).cast("long").alias("matched"), F.size(F.array_except("a", "b")).cast("long").alias("unmatched")),
        "WITH x AS (SELECT o_orderkey, list_distinct([o_custkey % 3, 1, 2]) AS a, list_distinct([o_orderkey % 4, 2]) AS b FROM orders) SELECT o_orderkey, CAST(len(list_intersect(a, b)) AS BIGINT) AS matched, CAST(len(a) - len(list_intersect(a, b)) AS BIGINT) AS unmatched FROM x",
    ),
    "jn_ref_candidate": (_candidates, None),
    "jn_bib_inline": (lambda s, d: docs(s, d).select("doc_id", F.round(citations.features(F.expr(BIB_SPARK), 2025, 0)["missing_inline_ratio"], 6).alias("missing")), None),
    "agg_entropy_norm": (lambda s, d: features.reasoning(docs(s, d)).select("doc_id", F.round("reasoning.word_entropy_normalised", 6).alias("entropy")), f"WITH d AS (SELECT doc_id, {WS % 'lower(text)'} AS w FROM documents), e AS (SELECT doc_id, len(w) AS n, {COUNTS % 'w'} AS c FROM d) SELECT doc_id, round(CASE WHEN n >= 20 AND len(c) >= 2 THEN -list_sum(list_transform(c, lambda x: x / n * log2(x / n + 1e-9))) / log2(len(c)) ELSE 0 END, 6) AS entropy FROM e"),
    "agg_ngram_rep": (_ngram_rep, f"WITH {W}, c AS (SELECT doc_id, len(w) AS n, {COUNTS % ('(' + GRAMS % dict(w='w', n=4) + ')')} AS c FROM w) SELECT doc_id, round(CASE WHEN n >= 4 THEN len(list_filter(c, lambda x: x > 1)) / (n - 3) ELSE 0 END, 6) AS rate FROM c"),
    "agg_sentence_stats": (_sentences, SENT_SQL),
    "agg_burstiness": (lambda s, d: _sentences(s, d).select("doc_id", "burstiness"), SENT_SQL.replace("SELECT doc_id, round(m, 6) AS mean, round(v, 6) AS var, round(s, 6) AS std, round(CASE", "SELECT doc_id, round(CASE")),
    "agg_doc_windows": (lambda s, d: _v(s, d).select("doc_id", F.round(C.mean(F.col("v")), 6).alias("mean"), F.round(F.size(F.filter("v", lambda x: x >= 5)) / F.size("v"), 6).alias("share")), f"WITH {V} SELECT doc_id, round(list_avg(v), 6) AS mean, round(len(list_filter(v, lambda x: x >= 5)) / len(v), 6) AS share FROM v"),
    "agg_distinct": (lambda s, d: docs(s, d).groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts")), "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY lang"),
    "agg_class_weight_v6": (lambda s, d: corpus.class_weights(docs(s, d), "lang").select("label", F.round("w_v6", 6).alias("w")), "SELECT lang AS label, round(382720 / count(*), 6) AS w FROM documents GROUP BY lang"),
    "win_ngrams": (lambda s, d: docs(s, d).select("lang", F.explode(C.ngrams(C.tok_word(TEXT_()), 3)).alias("g")).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("g").alias("types")), f"SELECT lang, count(*) AS n, count(DISTINCT g) AS types FROM (SELECT lang, unnest({GRAMS % dict(w='w', n=3)}) AS g FROM (SELECT lang, {WORD} AS w FROM documents)) GROUP BY lang"),
    "win_char_ngrams": (_project(types=lambda: F.size(F.array_distinct(style.char_ngrams(TEXT_(), 4))).cast("long")), "SELECT doc_id, CAST(len(list_distinct(CASE WHEN length(text) >= 4 THEN list_transform(range(1, length(text) - 2), lambda i: substr(text, i, 4)) ELSE [] END)) AS BIGINT) AS types FROM documents"),
    "win_sent_jaccard": (_jaccard, None),
    "win_sentences7": (_project(n=lambda: F.size(features.sentence_windows(TEXT_())).cast("long")), None),
    "win_hybrid100": (_hybrid, None),
    "win_halves": (lambda s, d: _v(s, d).select("doc_id", report.hybrid(F.transform("v", lambda x: x / 11)).alias("hybrid")), f"WITH {V}, h AS (SELECT doc_id, list_avg(v[1:10]) / 11 AS a, list_avg(v[11:21]) / 11 AS b FROM v) SELECT doc_id, abs(a - b) > 0.25 AND (a > 0.5) <> (b > 0.5) AS hybrid FROM h"),
    "win_position_decay": (lambda s, d: _v(s, d).select("doc_id", F.round(C.total(F.transform("v", lambda x, i: x * (1 - i / 21 * 0.1))), 6).alias("total")), f"WITH {V} SELECT doc_id, round(list_sum(list_transform(range(0, 21), lambda i: v[i + 1] * (1 - i / 21 * 0.1::DOUBLE))), 6) AS total FROM v"),
    "win_rank_avg": (_rank_avg, f"WITH {S}, c AS (SELECT p, count(*) AS c FROM s GROUP BY p) SELECT round(p, 6) AS p, coalesce(sum(c) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rank FROM c"),
    "win_autocorr": (lambda s, d: _v(s, d).select("doc_id", F.explode(F.array("v")).alias("v")).select("doc_id", F.round(watermark.entropy_periodicity("v"), 5).alias("peak")), AUTOCORR),
    "top_common": (_top_common, f"WITH c AS (SELECT source, g, count(*) AS n FROM (SELECT source, unnest({GRAMS % dict(w='w', n=2)}) AS g FROM (SELECT source, {WORD} AS w FROM documents)) GROUP BY ALL) SELECT source, r, g, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, g) AS r FROM c) WHERE r <= 10"),
    "top_argmax": (lambda s, d: _v(s, d).select("doc_id", ensemble.argmax(F.col("v")).alias("at")), f"WITH {V} SELECT doc_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS at FROM v"),
    "top_caps": (lambda s, d: _v(s, d).select("doc_id", C.total(F.slice("v", 1, 8)).alias("t")), f"WITH {V} SELECT doc_id, list_sum(v[1:8]) AS t FROM v"),
    "top_median": (_median, "SELECT lang, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.99) AS q99 FROM documents GROUP BY lang"),
    "top_candidate": (lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best")), "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS best FROM orders GROUP BY o_custkey"),
    "set_concat": (lambda s, d: docs(s, d).select("text").unionByName(s.read.parquet(f"{d}/benchmark.parquet").select("text", "item_id"), allowMissingColumns=True).agg(F.count("*").alias("n"), F.count("item_id").alias("items")), "SELECT count(*) AS n, count(item_id) AS items FROM (SELECT text, NULL AS item_id FROM documents UNION ALL SELECT text, item_id FROM benchmark)"),
    "set_ops_tokens": (_project(both=lambda: F.size(F.array_intersect(C.tok_word(TEXT_()), F.array(*map(F.lit, L.FUNCTION_WORDS)))).cast("long")), f"WITH {W} SELECT doc_id, CAST(len(list_intersect(w, {_in(L.FUNCTION_WORDS)})) AS BIGINT) AS both FROM w"),
    "fn_lexicon_ratio": _ratio(L.FUNCTION_WORDS),
    "fn_word_freq": _ratio(L.TRANSITIONS),
    "fn_assertive": (_project(ratio=lambda: F.round(C.share_in(C.tok_word(TEXT_()), L.ABSOLUTE) / F.greatest(C.share_in(C.tok_word(TEXT_()), L.ABSOLUTE + L.HEDGING), F.lit(1)), 6)), f"WITH {W} SELECT doc_id, round(len(list_filter(w, lambda x: x IN {_in(L.ABSOLUTE)})) / greatest(1, len(list_filter(w, lambda x: x IN {_in(L.ABSOLUTE + L.HEDGING)}))), 6) AS ratio FROM w"),
    "fn_regex_count": (_project(n=lambda: F.regexp_count(LOW(), F.lit("(?U)" + L.MARKERS["sequence_density"])).cast("long")), "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '" + L.MARKERS["sequence_density"] + "')) AS BIGINT) AS n FROM documents"),
    "fn_self_ref": (_project(n=lambda: sum((F.regexp_count(LOW(), F.lit(rf"(?U)\b{p}\b")) for p in L.SELF_REFERENCE), F.lit(0)).cast("long")), "SELECT doc_id, CAST(" + " + ".join(rf"len(regexp_extract_all(lower(text), '\b{p}\b'))" for p in L.SELF_REFERENCE) + " AS BIGINT) AS n FROM documents"),
    "fn_numbers": (_project(n=lambda: F.size(C.matches(TEXT_(), "[0-9]+")).cast("long"), long=lambda: F.size(F.filter(C.matches(TEXT_(), "[0-9]+"), lambda x: F.length(x) >= 4)).cast("long")), "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n, CAST(len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) >= 4)) AS BIGINT) AS long FROM documents"),
    "fn_temporal": (lambda s, d: features.hallucination(docs(s, d)).select("doc_id", F.round("hallucination.temporal_specificity", 6).alias("specificity")), None),
    "fn_uniformity": (lambda s, d: features.hallucination(docs(s, d)).select("doc_id", F.round("hallucination.sentence_length_uniformity", 6).alias("uniformity")), None),
    "fn_char_ratio": (_project(upper=lambda: F.round(F.regexp_count(TEXT_(), F.lit(r"\p{Lu}")) / F.greatest(F.length("text"), F.lit(1)), 6)), r"SELECT doc_id, round(len(regexp_extract_all(text, '\p{Lu}')) / greatest(length(text), 1), 6) AS upper FROM documents"),
    "fn_cosine": (_cosine, "WITH c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding[1:64]::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL) GROUP BY label) SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(embedding[1:64]::DOUBLE[], m))), 5) AS cosine FROM embeddings JOIN c USING (label)"),
    "fn_zscore": (lambda s, d: _v(s, d).select("doc_id", F.round(C.total(style.zscore(F.col("v"), F.array_repeat(F.lit(5.0), 21), F.array_repeat(F.lit(2.0), 21))), 6).alias("z")), f"WITH {V} SELECT doc_id, round(list_sum(list_transform(v, lambda x: (x - 5) / 2)), 6) AS z FROM v"),
    "fn_confidence": (lambda s, d: scores(s, d).select("doc_id", F.round(F.abs(F.col("p") - 0.5) * 2, 6).alias("confidence")), f"WITH {S} SELECT doc_id, round(abs(p - 0.5) * 2, 6) AS confidence FROM s"),
    "fn_binary_pct": (lambda s, d: scores(s, d).select("doc_id", F.round(F.col("p") * 100, 4).alias("ai"), (F.abs(F.col("p") * 2 - 1) * 100 < 15).alias("uncertain")), f"WITH {S} SELECT doc_id, round(p * 100, 4) AS ai, abs(p * 2 - 1) * 100 < 15 AS uncertain FROM s"),
    "fn_tamper_override": (lambda s, d: docs(s, d).select("doc_id", F.when(C.tamper(F.when(F.col("doc_id") % 2 == 0, SPOILED()).otherwise(TEXT_()))["suspicious"], "TAMPERED").otherwise("HUMAN").alias("verdict")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'TAMPERED' ELSE 'HUMAN' END AS verdict FROM documents"),
    "fn_risk_r_service": (lambda s, d: features.reasoning(docs(s, d)).select("doc_id", F.round(risk.reasoning_service_score(F.col("reasoning")), 6).alias("score")), None),
    "fn_level_r": (lambda s, d: features.reasoning(docs(s, d)).select("doc_id", *(risk.level(F.col(f"reasoning.{k}"), k).alias(k) for k in L.REASONING_THRESHOLDS)), None),
    "fn_entropy_stats": (lambda s, d: _v(s, d).select("doc_id", F.round(C.mean(F.col("v")), 6).alias("mean"), F.round(F.sqrt(C.variance(F.col("v"))), 6).alias("std"), F.round(C.let(C.mean(F.col("v")), lambda m: F.when(m == 0, float("nan")).otherwise((F.array_max("v") - F.array_min("v")) / m)), 6).alias("range_ratio")), f"WITH {V} SELECT doc_id, round(list_avg(v), 6) AS mean, round(list_aggregate(v, 'stddev_pop'), 6) AS std, round((list_max(v) - list_min(v)) / list_avg(v), 6) AS range_ratio FROM v"),
    "fn_attr_word": (lambda s, d: docs(s, d).select("doc_id", report.word_scores(TEXT_(), F.lit(0.6)).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.round(C.mean(F.transform("w", lambda x: x["score"])), 6).alias("mean")), None),
    "tf_bib_split": (lambda s, d: docs(s, d).select("doc_id", citations.split_bibliography(F.expr(BIB_SPARK)).alias("b")).select("doc_id", F.length("b.body").cast("long").alias("body"), F.length("b.bib").cast("long").alias("bib")), None),
    "tf_explode_list": (lambda s, d: docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(F.count("*").alias("n")), "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"),
    **{f"atk_{k}": (_attacked(k), None) for k in ("homoglyph", "zero_width", "char_noise", "whitespace")},
    "aug_v6": (_aug_v6, None),
    "aug_v7": (_aug_v7, None),
    "top_signals_h": (lambda s, d: features.hallucination(docs(s, d)).select("doc_id", F.explode(risk.top_values(F.col("hallucination"), features.HALLUCINATION)).alias("x")).select("doc_id", "x.feature", F.round("x.value", 6).alias("value")), None),
    "top_signals_r": (lambda s, d: features.reasoning(docs(s, d)).select("doc_id", F.explode(risk.top_signals(F.col("reasoning"))).alias("x")).select("doc_id", "x.feature", F.round("x.value", 6).alias("value")), None),
    "fn_level_h": (lambda s, d: features.hallucination(docs(s, d)).select("doc_id", F.explode(risk.category_levels(F.col("hallucination"))).alias("category", "level")), None),
    "fn_baseline": (lambda s, d: docs(s, d).select("doc_id", F.explode(risk.baseline(F.lit(40) + F.col("doc_id") % 30, F.lit(0.1) + F.col("doc_id") % 5 / 20, F.lit(0.5) + F.col("doc_id") % 6 / 20, F.lit(10) + F.col("doc_id") % 15, corpus.flesch_kincaid(TEXT_(), None))).alias("b")).select("doc_id", "b.metric", "b.value", "b.deviates"), None),
    "jn_group_calib": (lambda s, d: ensemble.with_thresholds(scores(s, d), ensemble.conformal(scores(s, d), 0.05, "lang", 50), "lang").select("doc_id", F.round("tau_ai", 6).alias("tau_ai")), None),
    "agg_class_weight_v7": (lambda s, d: corpus.class_weights(docs(s, d), "source").select("label", F.round("w_v7", 6).alias("w")), "WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, sqrt(sum(n + 1) OVER () / (n + 1)) AS r FROM c) SELECT label, round(r / avg(r) OVER (), 6) AS w FROM r"),
    "agg_paragraph_cv": (lambda s, d: features.reasoning(docs(s, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))).select("doc_id", F.round("reasoning.paragraph_length_cv", 6).alias("cv")), None),
}
