"""What reports show: levels, explanations, merged statistics, indicators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import corpus, ensemble, features, levels, render, report, style
from ..session import Stage
from ..sources import files
from .ensemble import PROB_SQL, _gates, _votes
from .features import COUNTS, GRAMS, SERIES, SERIES_SQL, STYLE_SQL, WORD, WS
from .sql import sentence_sql
from .text import docs

#: Metric to the style feature it shows.
SHOWN = {"burstiness": "burstiness", "lexical_diversity": "type_token_ratio", "avg_sentence_length": "sent_len_mean", "sentence_length_variance": "sent_len_var", "avg_word_length": "avg_word_len", "vocabulary_richness": "type_token_ratio", "hapax_legomena_ratio": "hapax_ratio"}
PROFILE = {k: SHOWN[k] for k in ("burstiness", "lexical_diversity", "avg_sentence_length", "sentence_length_variance")}


def _style(spark, d):
    return features.style_v7(docs(spark, d)).select("doc_id", *(F.round(f"style_v7.{k}", 6).alias(k) for k in dict.fromkeys(SHOWN.values())))


def _levels(spark, d):
    return _style(spark, d).select("doc_id", F.explode(levels.style_levels({k: F.col(v) for k, v in SHOWN.items()})).alias("x")).select("doc_id", "x.*")


def _explained(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(report.sentence_scores(F.col("text"), F.lit(0.6))).alias("s"))
    return s.select("doc_id", "s.position", F.md5(levels.explain_sentence(F.col("s.score"), F.col("s.indicators"))).alias("explanation"))


def _merged(spark, d):
    detected = {"ppl": (F.col("doc_id") % 3 * 20).cast("double"), "burstiness": (F.col("doc_id") % 4 * 0.125)}
    given = {"entropy": F.when(F.col("doc_id") % 5 == 0, 4.5)}
    s = levels.merged_stats({k: F.col(v) for k, v in PROFILE.items()}, detected, given)
    return _style(spark, d).select("doc_id", s.alias("s")).select("doc_id", "s.*")


def _batch(spark, d):
    v = _votes(spark, d).select("doc_id", ensemble.gates(F.col("probs"), F.col("votes_ai"), F.col("agree_top"), "strict").alias("g"), ensemble.two_stage(F.col("probs")).alias("t"))
    return v.select("doc_id", "g.verdict", F.round("t.p_ai", 6).alias("p_ai"), F.col("t.top_ai_model").alias("model"))


def _distance(spark, d):
    v = lambda i: F.get("v", F.lit(i)) + 1
    return docs(spark, d).select("doc_id", F.expr(SERIES).alias("v")).select("doc_id", F.round(levels.syntactic_distance([v(i) for i in range(4)], [v(i + 4) for i in range(4)]), 6).alias("distance"))


SAMPLES = ["We went down to the river, and it was cold; nobody swam.", "It rained all day! So we stayed in, read, and talked about the long summer.", "Who knows? The boats left early, the wind was high, and we watched them go.", "She said little, as ever. The tea was strong, the bread was old."]


def _quick(spark, d):
    out = style.quick_compare(docs(spark, d).select("doc_id", "text"), SAMPLES)
    return out.select("doc_id", F.round("similarity", 6).alias("similarity"), "comparison.same_author", F.size("comparison.anomalous").alias("n_anomalous"))


#: Results of every kind: verdicts, levels, marks and errors by doc_id.
RESULT = """struct(CASE WHEN doc_id % 7 = 0 THEN 'Unknown' WHEN doc_id % 2 = 0 THEN 'Human' ELSE 'AI' END AS prediction, cast(doc_id % 97 / 97 AS double) AS human, cast(1 - doc_id % 97 / 97 AS double) AS ai,
    cast(50 + doc_id % 49 + 0.25 AS double) AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'GPT' END AS model, CASE WHEN doc_id % 3 = 0 THEN 'AI' END AS forensic,
    CASE WHEN doc_id % 4 > 0 THEN named_struct('level', elt(cast(doc_id % 4 AS int), 'LOW', 'MEDIUM', 'HIGH'), 'risk', cast(doc_id % 4 / 4 AS double)) END AS hallucination,
    CASE WHEN doc_id % 6 > 1 THEN named_struct('detected', doc_id % 6 > 3, 'scheme', 'green', 'confidence', cast(doc_id % 6 / 7 AS double)) END AS watermark,
    CASE WHEN doc_id % 8 > 0 THEN cast(doc_id % 8 / 9 AS double) END AS reasoning, CASE WHEN doc_id % 9 = 0 THEN array('a', 'b') WHEN doc_id % 9 > 4 THEN cast(array() AS array<string>) END AS errors)"""


def _rendered(spark, d):
    r = F.col("r")
    return docs(spark, d).select("doc_id", F.expr(RESULT).alias("r")).select("doc_id", F.md5(render.markdown(r)).alias("markdown"), render.short_summary(r).alias("line"), F.md5(render.detector_markdown(r)).alias("detector"))


def _said(name, *values):
    """SQL of a wording of L.RENDERED: each place of its values as text."""
    parts, rest = [], L.RENDERED[name]
    for value in values:
        at = re.search(r"%(?:\.(\d))?([sfd])", rest)
        parts += [rest[: at.start()], f"format('{{:.{at[1]}f}}', {value})" if at[2] == "f" else f"CAST({value} AS VARCHAR)"]
        rest = rest[at.end() :]
    quoted = lambda x: "'" + x.replace("%%", "%").replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(quoted(x) if k % 2 == 0 else x for k, x in enumerate([*parts, rest]))


def _signs(of):
    return "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.RENDERED[of].items()) + " END"


RENDER_SQL = f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Unknown' WHEN doc_id % 2 = 0 THEN 'Human' ELSE 'AI' END AS prediction, (doc_id % 97 / 97)::DOUBLE AS human, (1 - doc_id % 97 / 97)::DOUBLE AS ai,
    (50 + doc_id % 49 + 0.25)::DOUBLE AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE 'GPT' END AS model, CASE WHEN doc_id % 3 = 0 THEN 'AI' END AS forensic,
    CASE WHEN doc_id % 4 > 0 THEN ['LOW', 'MEDIUM', 'HIGH'][doc_id % 4] END AS level, (doc_id % 4 / 4)::DOUBLE AS risk, doc_id % 6 > 3 AS detected, (doc_id % 6 / 7)::DOUBLE AS sure,
    CASE WHEN doc_id % 8 > 0 THEN (doc_id % 8 / 9)::DOUBLE END AS reasoning, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 0 END AS n FROM documents),
    h AS (SELECT *, human / (human + ai + 1e-9) * 100 AS h FROM r),
    s AS (SELECT *, array_to_string(list_filter([CASE WHEN forensic <> prediction THEN {_said('forensic', 'forensic')} END, CASE WHEN level IS NOT NULL THEN {_said('risk', _signs('risk_signs'), 'level', "format('{:.0f}%', risk * 100)")} END,
        CASE WHEN detected THEN {_said('watermark', "'green'", "format('{:.0f}%', sure * 100)")} END, CASE WHEN reasoning > 0.4::DOUBLE THEN {_said('reasoning', 'reasoning')} END, CASE WHEN n > 0 THEN {_said('errors', "'a, b'")} END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS below,
        array_to_string(list_filter([CASE WHEN prediction = 'Human' THEN {_said('human', 'confidence')} ELSE {_said('ai', 'confidence')} END, CASE WHEN prediction <> 'Human' AND model <> 'unknown' THEN {_said('detector_model', 'model')} END,
        CASE WHEN reasoning IS NOT NULL THEN {_said('detector_reasoning', 'reasoning', f"CASE WHEN reasoning > 0.5::DOUBLE THEN '{L.RENDERED['high_cot']}' ELSE '{L.RENDERED['low_cot']}' END")} END,
        CASE WHEN level IS NOT NULL THEN {_said('detector_risk', _signs('detector_risk_signs'), 'level', "format('{:.1f}%', risk * 100)")} END, CASE WHEN detected THEN {_said('detector_watermark', "'green'", "format('{:.1f}%', sure * 100)")} END,
        CASE WHEN n > 0 THEN {_said('detector_errors', "'a, b'")} END], lambda x: x IS NOT NULL), chr(10)) AS detector FROM h)
    SELECT doc_id, md5(CASE WHEN prediction = 'Unknown' THEN '{L.RENDERED['unknown']}' ELSE (CASE WHEN prediction = 'Human' THEN {_said('human', 'h')} ELSE {_said('ai', '(100 - h)')} END) || CASE WHEN below <> '' THEN chr(10) || chr(10) || below ELSE '' END END) AS markdown,
        {_said('line', 'prediction', 'confidence', 'model', "coalesce(forensic, 'N/A')", "coalesce(level, 'N/A')", "CASE WHEN detected THEN 'YES' ELSE 'NO' END", 'n')} AS line, md5(detector) AS detector FROM s"""


def _profiles(spark, d):
    """Profiles as earlier versions stored them: some lack their version, a scalar or the threshold."""
    path = Stage(spark, "profiles").path("p")
    stored = docs(spark, d).select(
        F.concat(F.lit("a"), F.col("doc_id")).alias("author_id"), F.when(F.col("doc_id") % 2 == 0, "2.1").alias("schema_version"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") / 8).alias("burstiness_score"),
        F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 16 / 16).alias("adaptive_threshold"), F.array(F.col("doc_id") / 2, F.lit(1.5)).alias("feature_mean"), F.lit("kept nowhere").alias("other"),
    )
    files.write_json(stored, path)
    return files.read_profiles(spark, path, style.SCALARS).select("author_id", "schema_version", "pos_bigrams_source", "burstiness_score", "avg_tree_depth", "adaptive_threshold", F.element_at("feature_mean", 1).alias("first"), "comma_rate")


def _artifacts(spark, d):
    """Split sizes and class counts, written beside each other and read again as one table."""
    base = docs(spark, d).select("doc_id", "lang", corpus.split_random(F.col("doc_id")).alias("split"))
    tables = {"split_sizes": base.groupBy("split").agg(F.count("*").alias("n")), "languages": base.groupBy("lang").agg(F.count("*").alias("n"))}
    path = Stage(spark, "artifacts").path("run")
    files.write_artifacts(tables, path)
    read = [files.read_artifact(t, path, k).select(F.lit(k).alias("artifact"), F.col(t.columns[0]).alias("key"), "n") for k, t in tables.items()]
    return read[0].unionByName(read[1])


def _level_sql(metric, value):
    low, high = L.STYLE_LEVELS[metric]
    return f"CASE WHEN {value} >= {high}::DOUBLE THEN 'HIGH' WHEN {value} >= {low}::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END"


_SAID = "CASE " + " ".join(f"WHEN score >= {least}::DOUBLE THEN '{words}'" for least, words in L.SENTENCE_TEXTS[:-1]) + f" ELSE '{L.SENTENCE_TEXTS[-1][1]}' END"
_BEFORE, _AFTER = L.INDICATORS_TEXT.split("%s")
_WORDS = [(w, "ai", s) for w, s in report.AI_WORDS.items()] + [(w, "human", s) for w, s in report.HUMAN_WORDS.items() if w not in report.AI_WORDS]

ALL = {
    "fn_quick_compare": (_quick, None),
    "fn_render": (_rendered, RENDER_SQL),
    "src_profile_json": (
        _profiles,
        "SELECT 'a' || doc_id AS author_id, CASE WHEN doc_id % 2 = 0 THEN '2.1' ELSE '1.0' END AS schema_version, 'none' AS pos_bigrams_source, CASE WHEN doc_id % 3 > 0 THEN doc_id / 8 ELSE 0 END::DOUBLE AS burstiness_score, 0.0::DOUBLE AS avg_tree_depth, CASE WHEN doc_id % 5 > 0 THEN doc_id % 16 / 16 END::DOUBLE AS adaptive_threshold, (doc_id / 2)::DOUBLE AS first, CAST(NULL AS DOUBLE) AS comma_rate FROM documents",
    ),
    "sink_artifacts": (
        _artifacts,
        "WITH s AS (SELECT lang, CASE WHEN ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 6))::BIGINT < 1677721 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT 'split_sizes' AS artifact, split AS key, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'languages', lang, count(*) FROM s GROUP BY lang",
    ),
    "fn_style_levels": (_levels, f"SELECT doc_id, unnest({list(SHOWN)}) AS metric, unnest([{', '.join(SHOWN.values())}]) AS value, unnest([{', '.join(_level_sql(k, v) for k, v in SHOWN.items())}]) AS level FROM ({STYLE_SQL})"),
    "prj_explain": (_explained, f"{sentence_sql(0.6)} SELECT doc_id, CAST(position AS INT) AS position, md5({_SAID} || CASE WHEN len(marks) > 0 THEN '{_BEFORE}' || array_to_string(marks[1:3], '; ') || '{_AFTER}' ELSE '{L.NO_INDICATORS_TEXT}' END) AS explanation FROM m"),
    "prj_sentinel_profile": (
        _merged,
        f"SELECT doc_id, coalesce(nullif(doc_id % 3 * 20, 0), 50)::DOUBLE AS ppl, coalesce(nullif(doc_id % 4 * 0.125::DOUBLE, 0), burstiness) AS burstiness, CASE WHEN doc_id % 5 = 0 THEN 4.5 ELSE 0 END::DOUBLE AS entropy, type_token_ratio AS lexical_diversity, sent_len_mean AS avg_sentence_length, sent_len_var AS sentence_length_variance, 0.0::DOUBLE AS flesch_kincaid_grade FROM ({STYLE_SQL})",
    ),
    "fn_syntactic_dist": (_distance, f"WITH v AS (SELECT doc_id, list_transform({SERIES_SQL}, lambda x: x + 1) AS v FROM documents) SELECT doc_id, round(list_avg(list_transform(range(1, 5), lambda i: abs(v[i] - v[i + 4]) / (abs(v[i]) + 1e-9))), 6) AS distance FROM v"),
    "jn_indicator": (
        lambda s, d: levels.indicators(docs(s, d)).select("doc_id", "kind", "n", F.round("weight", 6).alias("weight")),
        f"WITH t AS (SELECT unnest({[w for w, _, _ in _WORDS]}) AS word, unnest({[k for _, k, _ in _WORDS]}) AS kind, unnest({[s for _, _, s in _WORDS]})::DOUBLE AS strength), w AS (SELECT doc_id, regexp_replace(unnest({WS % 'lower(text)'}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', '', 'g') AS word FROM documents) SELECT doc_id, kind, count(*) AS n, round(sum(strength), 6) AS weight FROM w JOIN t USING (word) GROUP BY ALL".replace("\\\\", "\\"),
    ),
    "agg_cap_counter": (
        lambda s, d: docs(s, d).select("doc_id", C.tok_word(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", levels.counter(C.ngrams(F.col("w"), 2)).alias("c")).select("doc_id", "c.*"),
        f"WITH w AS (SELECT doc_id, coalesce({WORD}, []) AS w FROM documents), c AS (SELECT doc_id, {COUNTS % ('(' + GRAMS % dict(w='w', n=2) + ')')} AS c FROM w) SELECT doc_id, CAST(coalesce(len(c), 0) AS BIGINT) AS types, CAST(coalesce(list_max(c), 0) AS BIGINT) AS most FROM c",
    ),
    "fn_batch_v6": (_batch, f"WITH {PROB_SQL}, x AS (SELECT doc_id, ps, ps[2:7] AS a FROM g) SELECT doc_id, verdict, round(1 - ps[1], 6) AS p_ai, {L.LABELS_V6[1:]}[list_position(a, list_max(a))] AS model FROM x JOIN ({_gates('strict')[1]}) USING (doc_id)"),
}
