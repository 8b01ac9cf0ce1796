"""Queries whose inputs are the tables' own texts, words, counts and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import citations, corpus, report, risk, style, watermark
from ..session import Stage
from ..sources import files
from .corpus import DICT_SQL
from .ensemble import _canonical_drop
from .features import SENT, WORD, WS, _in
from .sql import ATTACKS, _canonical, sentence_sql
from .text import LABEL, _case, _project, docs

TEXT = lambda: F.col("text")
N = lambda: F.size(C.tok_ws(F.col("text")))
N_SQL = f"len({WS % 'text'})"
FIRST, FIRST_SQL = "coalesce(nullif(regexp_extract(text, '[A-Z][a-z]{2,}', 0), ''), 'Zed')", "coalesce(nullif(regexp_extract(text, '[A-Z][a-z]{2,}', 0), ''), 'Zed')"


def _folder(spark, d):
    """Each document as a file of its own, read as a corpus folder."""
    path = Stage(spark, "folder").path("texts")
    files.write_texts(docs(spark, d).select("text"), path)
    return files.dictionary_texts(spark, path, "folder").select(F.md5("text").alias("text"))


def _infer(spark, d):
    """Rows whose label and domain are in columns of different names, as corpora have them."""
    base = docs(spark, d).select("doc_id", "text", F.expr(LABEL).alias("raw"), "source", "lang")
    parts = [base.filter(F.col("doc_id") % 3 == k).select("text", F.col("raw").alias(label), *([F.col(of).alias(domain)] if domain else [])) for k, (label, domain, of) in enumerate((("model", "domain", "source"), ("target_model", "idiom", "lang"), ("label", None, None)))]
    out = None
    for p in parts:
        rows = corpus.label_rows(p)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("label", "domain").agg(F.count("*").alias("n"))


def _ready(spark, d):
    """Which tables are there, and how many rows they have."""
    names = ["documents", "labels", "pages", "benchmark", "nothing"]
    there = files.ready(spark, [f"{d}/{n}.parquet" for n in names])
    out = None
    for n, ok in zip(names, there.values(), strict=True):
        row = (spark.read.parquet(f"{d}/{n}.parquet") if ok else spark.range(0)).agg(F.lit(n).alias("name"), F.lit(ok).alias("there"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def _fuse(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.posexplode(style.fuse(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


def _profiles(spark, d):
    return style.stylometric(docs(spark, d).select("doc_id", "source", "text"))


def _compare(spark, d):
    """Each document against the mean profile of its source."""
    s = Stage(spark, "compare").table(_profiles(spark, d).select("doc_id", "source", "style"), "styles")
    mean = s.groupBy("source").agg(F.struct(*(F.avg(f"style.{k}").alias(k) for k in style.SCALARS)).alias("profile"))
    both = s.join(mean, "source")
    out = both.select("doc_id", style.compare(F.col("profile"), F.col("style"), F.lit(0.7), F.lit(0.5)).alias("c"))
    return out.select("doc_id", "c.same_author", F.size("c.anomalous").cast("long").alias("anomalous"), F.round("c.confidence", 6).alias("confidence"), F.round(F.col("c.distances")["comma_rate"], 4).alias("commas"))


def _centroids(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return style.centroids(e, "label", "v", 64).select(F.col("author").alias("label"), "n", F.posexplode(F.arrays_zip("mean", "std")).alias("i", "x")).select("label", "n", F.col("i").cast("long").alias("i"), F.round("x.mean", 5).alias("m"), F.round("x.std", 5).alias("s"))


@F.pandas_udf(T.LongType())
def _green_tokens(ids: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([int(watermark.green(int(s), 1000, 0.5)[list(x)].sum()) if x is not None and len(x) else 0 for x, s in zip(ids, seed, strict=True)])


def _green(spark, d):
    """How many of a document's tokens (its words' digests, in a vocabulary of 1,000) a seed of its own puts on the green list, and on the red one."""
    t = docs(spark, d).select("doc_id", F.transform(C.tok_ws(TEXT()), lambda w: F.pmod(F.crc32(w), F.lit(1000)).cast("int")).alias("ids"))
    return t.select("doc_id", _green_tokens("ids", F.col("doc_id") % 16).alias("green"), F.size("ids").cast("long").alias("n")).select("doc_id", "n", "green", (F.col("n") - F.col("green")).alias("red"))


def _numbered(spark, d):
    refs = F.concat(TEXT(), F.lit("\nReferences\n[1] Doe, A. \""), F.expr(FIRST), F.lit(" study\", "), (F.lit(1950) + N() % 70).cast("string"), F.lit(".\n[2] Roe. The "), F.expr(FIRST), F.lit(" without quotes. 1999"))
    return docs(spark, d).select("doc_id", F.explode(citations.numbered(refs)).alias("r")).select("doc_id", "r.position", "r.year", "r.title")


def _confidence(spark, d):
    """References made of the parts' names against the parts as a catalogue: titles and journals that are equal or missing, years and authors that differ."""
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    refs = p.select(
        k.alias("ref_id"), F.when(k % 5 > 0, F.col("p_name")).alias("title"), F.when(k % 4 == 0, F.array(F.lower("p_brand"), F.lit("doe"))).when(k % 4 == 1, F.array(F.lit("roe"))).when(k % 4 == 2, F.array(F.lower("p_brand"))).alias("authors"), F.when(k % 7 > 0, F.lit(1990) + F.col("p_size") + k % 3).cast("int").alias("year"), F.when(k % 2 == 0, F.col("p_type")).alias("journal"),
        F.col("p_name").alias("c_title"), F.array(F.lower("p_brand")).alias("c_authors"), (F.lit(1990) + F.col("p_size")).cast("int").alias("c_year"), F.col("p_type").alias("c_journal"),
    )
    return citations.confidence(refs).select("ref_id", F.round("confidence", 4).alias("confidence"))


def _seq(spark, d):
    """Whole names of parts against those of the next part."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(after, "p_partkey").select("p_partkey", F.round(citations.sequence_ratio("p_name", "other"), 6).alias("ratio"))


MATTR = "CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 100 THEN len(list_distinct(w)) / len(w) ELSE list_avg(list_transform(range(0, len(w) - 99, CASE WHEN len(w) < 2000 THEN 1 WHEN len(w) < 10000 THEN 5 ELSE 10 END), lambda i: len(list_distinct(w[i + 1:i + 100])) / 100)) END"


def _rate(*pieces):
    return "(" + " + ".join(f"(length(text) - length(replace(text, '{p}', ''))) // {len(p)}" for p in pieces) + ") / greatest(len(sl), 1)"


SCALARS = {
    "vocabulary_richness": MATTR, "avg_word_length": "length(array_to_string(w, '')) / greatest(len(w), 1)", "rare_word_ratio": "len(list_filter(c, lambda x: x < 3)) / greatest(len(w), 1)", "hapax_legomena_ratio": "len(list_filter(c, lambda x: x < 2)) / greatest(len(w), 1)",
    "comma_rate": _rate(","), "semicolon_rate": _rate(";"), "exclamation_rate": _rate("!"), "question_rate": _rate("?"), "ellipsis_rate": _rate("..."), "dash_rate": _rate("—", "–", " - "),
    "avg_sentence_length": "coalesce(list_avg(sl), 0)", "sentence_length_variance": "coalesce(list_aggregate(sl, 'var_pop'), 0)", "avg_paragraph_length": "coalesce(list_avg(pl), 0)",
    **dict.fromkeys(("avg_dep_distance", "max_dep_distance", "avg_tree_depth", "complex_sentence_ratio"), "0"),
    "burstiness_score": "CASE WHEN len(sl) < 3 OR list_avg(sl) + list_aggregate(sl, 'stddev_pop') < 1e-9 THEN 0 ELSE (list_aggregate(sl, 'stddev_pop') - list_avg(sl)) / (list_aggregate(sl, 'stddev_pop') + list_avg(sl)) END",
}
#: Table p: doc_id, source and the scalars of each document's style.
PROFILE = rf"""WITH a AS (SELECT doc_id, source, text, {WORD} AS w, list_transform({SENT % 'text'}, lambda x: len({WS % 'x'})) AS sl, list_transform(list_filter(string_split(text, chr(10) || chr(10)), lambda s: regexp_matches(s, '\S')), lambda s: len({WS % 's'})) AS pl FROM documents),
    b AS (SELECT *, CASE WHEN len(w) > 0 THEN map_values(list_aggregate(w, 'histogram')) ELSE [] END AS c FROM a), p AS (SELECT doc_id, source, {', '.join(f"CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 THEN {v} ELSE 0 END::DOUBLE AS {k}" for k, v in SCALARS.items())} FROM b)"""
_DIFF = "abs(m.{k} - p.{k}) / (abs(m.{k}) + 1e-9)"
_ODD = " + ".join(f"({_DIFF.format(k=k)} > 0.30::DOUBLE)::INT" for k in style.EXPLAINED)
_FUNCTION = f"len(list_filter(regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN {_in(L.FUNCTION_WORDS)})) / greatest(len(regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}_]+')), 1)"
_OF = lambda x: _FUNCTION % (x, x)
_AUTHORS = "CASE WHEN ref_id % 4 = 0 THEN 30 / 2 - 15 WHEN ref_id % 4 = 1 THEN (CASE WHEN ts > 0.85 THEN -20 ELSE 0 END) - 15 WHEN ref_id % 4 = 2 THEN 30 ELSE 0 END"

ALL = {
    "src_dict_folder": (_folder, DICT_SQL),
    "src_infer_cols": (
        _infer,
        f"""WITH a AS (SELECT {_case(L.FAMILIES_V7, LABEL, 'NULL')} AS label, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang END AS domain, text FROM documents)
            SELECT label, domain, count(*) AS n FROM a WHERE label IS NOT NULL AND regexp_matches(text, '\\S') GROUP BY label, domain""",
    ),
    "verify_ready": (_ready, " UNION ALL ".join(f"SELECT '{n}' AS name, true AS there, count(*) AS rows FROM {n}" for n in ("documents", "labels", "pages", "benchmark")) + " UNION ALL SELECT 'nothing', false, 0"),
    "fn_fuse": (
        _fuse,
        "WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v[1:32], lambda x: x * x))) + 1e-9 AS a, sqrt(list_sum(list_transform(v[33:64], lambda x: x * x))) + 1e-9 AS b FROM a) SELECT vec_id, i, round(CASE WHEN i < 32 THEN v[i + 1] / a * 0.6::DOUBLE ELSE v[i + 1] / b * (1 - 0.6::DOUBLE) END, 5) AS x FROM n, range(0, 64) t(i)",
    ),
    "agg_profile": (lambda s, d: _profiles(s, d).groupBy("source").agg(F.count("*").alias("n"), *(F.round(F.avg(f"style.{k}"), 5).alias(k) for k in style.SCALARS)), f"{PROFILE} SELECT source, count(*) AS n, {', '.join(f'round(avg({k}), 5) AS {k}' for k in style.SCALARS)} FROM p GROUP BY source"),
    "fn_rel_diff": (
        _compare,
        f"""{PROFILE}, m AS (SELECT source, {', '.join(f'avg({k}) AS {k}' for k in style.SCALARS)} FROM p GROUP BY source), x AS (SELECT p.doc_id, {_ODD} AS odd, {_DIFF.format(k='comma_rate')} AS commas FROM p JOIN m USING (source))
            SELECT doc_id, true AS same_author, CAST(odd AS BIGINT) AS anomalous, round(least(1, 0.7::DOUBLE + 0.1::DOUBLE * (1 - odd / {len(style.EXPLAINED)})), 6) AS confidence, round(commas, 4) AS commas FROM x""",
    ),
    "agg_mean_centroid": (_centroids, "SELECT label, count(*) AS n, i, round(avg(x), 5) AS m, round(stddev_pop(x), 5) AS s FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding[1:64]::DOUBLE[]) AS x FROM embeddings) GROUP BY label, i"),
    "fn_green_mask": (_green, None),
    "tf_numbered": (_numbered, f"SELECT doc_id, unnest([1, 2])::INT AS position, unnest([1950 + {N_SQL} % 70, 1999])::INT AS year, unnest([{FIRST_SQL} || ' study', 'The ' || {FIRST_SQL} || ' without quotes']) AS title FROM documents"),
    "fn_ref_confidence": (
        _confidence,
        f"""WITH a AS (SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 5 > 0 THEN 1.0 ELSE 0.0 END AS ts FROM part)
            SELECT ref_id, round(greatest(0.0, least(100.0, ts * 40 - CASE WHEN ts < 0.5 THEN 20 ELSE 0 END + {_AUTHORS} + CASE WHEN ref_id % 7 = 0 THEN 0 WHEN ref_id % 3 = 0 THEN 15 WHEN ref_id % 3 = 1 THEN 10 ELSE 5 END + CASE WHEN ref_id % 2 = 0 THEN 15 ELSE 0 END))::DOUBLE, 4) AS confidence FROM a""",
    ),
    "fn_surnames": (
        lambda s, d: docs(s, d).select("doc_id", F.array_join(citations.author_surnames(F.concat(F.expr(FIRST), F.lit(", J. A., Brown, B., "), F.when(F.col("doc_id") % 2 == 0, "& ").otherwise("and "), F.expr(FIRST), F.lit("ville, C., et al."))), "|").alias("names")),
        f"SELECT doc_id, lower({FIRST_SQL}) || '|brown|' || lower({FIRST_SQL}) || 'ville' AS names FROM documents",
    ),
    "fn_seq_ratio": (_seq, None),
    "fn_hash_context": (
        _project(h=lambda: F.conv(F.substring(F.sha2(F.concat(F.lit("3:"), N().cast("string"), F.lit(":"), F.length("text").cast("string")), 256), 1, 8), 16, 10).cast("long")),
        f"SELECT doc_id, CAST(('0x' || substr(sha256('3:' || {N_SQL} || ':' || length(text)), 1, 8)) AS BIGINT) AS h FROM documents",
    ),
    "fn_offline_ref": (
        _project(score=lambda: citations.offline((F.lit(1850) + N() % 200).cast("int"), F.when(F.length("text") % 3 == 0, "bad").otherwise(F.concat(F.lit("10.1234/"), F.expr(FIRST))), 2025)["score"]),
        f"SELECT doc_id, greatest(0.0, CASE WHEN 1850 + {N_SQL} % 200 > 2026 OR 1850 + {N_SQL} % 200 < 1900 THEN 20.0 ELSE 50.0 END - CASE WHEN length(text) % 3 = 0 THEN 20.0 ELSE 0.0 END)::DOUBLE AS score FROM documents",
    ),
    "fn_risk_v": (
        _project(score=lambda: risk.reference_risk(N() % 3, (N() % 100).cast("double"), N() % 10 / 20, F.lit(0.0), F.length("text") % 7 / 10)),
        f"""WITH a AS (SELECT doc_id, {N_SQL} AS n, length(text) % 7 AS idle FROM documents) SELECT doc_id, CASE WHEN n % 3 < 1 THEN 0.0 ELSE round(((CASE WHEN n % 100 < 40 THEN 1.0 WHEN n % 100 < 70 THEN 0.5 ELSE 0 END) + (CASE WHEN n % 10 / 20 > 0.3::DOUBLE THEN 1.0 WHEN n % 10 / 20 > 0.1::DOUBLE THEN 0.5 ELSE 0 END)
            + (CASE WHEN idle / 10 > 0.5::DOUBLE THEN 1.0 WHEN idle / 10 > 0.2::DOUBLE THEN 0.5 ELSE 0 END))::DOUBLE / 4, 4) END AS score FROM a""",
    ),
    "fn_sentence_level": (
        lambda s, d: docs(s, d).select("doc_id", F.explode(report.sentence_scores(TEXT(), F.expr("cast(doc_id % 97 / 97 as double)"))).alias("s")).select("doc_id", "s.position", report.sentence_level(F.round("s.score", 9)).alias("level")),
        f"{sentence_sql('(doc_id % 97 / 97)')} SELECT doc_id, CAST(position AS INT) AS position, CASE WHEN round(score, 9) >= 0.85::DOUBLE THEN 'very high' WHEN round(score, 9) >= 0.65::DOUBLE THEN 'high' WHEN round(score, 9) >= 0.45::DOUBLE THEN 'uncertain' WHEN round(score, 9) >= 0.25 THEN 'low' ELSE 'very low' END AS level FROM m",
    ),
    "fn_watermark_rule": (
        _project(**{k: (lambda k=k: watermark.rule(N() % 5 + 0.5, F.length("text") % 10 / 100, F.when(N() % 2 == 0, 0.6).otherwise(0.5), F.when(N() % 3 == 0, 0.3).otherwise(0.1))[k]) for k in ("detected", "scheme")}),
        f"""WITH a AS (SELECT doc_id, {N_SQL} AS n, length(text) % 10 < 5 AND {N_SQL} % 5 + 0.5 > 2 AS found FROM documents) SELECT doc_id, found AS detected, CASE WHEN NOT found THEN 'none' WHEN n % 2 = 0 THEN 'green_red' WHEN n % 3 = 0 THEN 'periodic' ELSE 'unknown' END AS scheme FROM a""",
    ),
    "agg_attack_drop": (
        _canonical_drop,
        " UNION ALL ".join(f"SELECT '{k}' AS attack, round(avg({_OF('text')}), 5) AS plain, round(avg({_OF('a')}), 5) AS attacked, round(avg({_OF('text')}) - avg({_OF('a')}), 5) AS lost, round(avg({_OF(_canonical('text'))}) - avg({_OF(_canonical('a'))}), 5) AS \"left\" FROM (SELECT text, {v} AS a FROM documents WHERE text IS NOT NULL)" for k, v in ATTACKS.items()),
    ),
}
