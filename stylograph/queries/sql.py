"""DuckDB SQL of the feature vectors and scores that other queries build on."""

from __future__ import annotations

import zlib

from ..functions import lexicons as L
from ..operators import citations, corpus, features, report
from .corpus import MINHASH_SQL
from .ensemble import CONFORMAL, S
from .features import CAPITAL, COUNTS, GRAMS, REASONING_CTE, REASONING_VALUES, SENT, WORD, WS, _in, ppl_cte
from .text import BIB, FK_CTE, FK_VALUE, FK_WHOLE, FOLD, SPOILED_SQL, ZW

# reasoning
R = REASONING_CTE + ", r AS (SELECT doc_id, " + ", ".join(f"if(n >= 20, {v}, 0)::DOUBLE AS {k}" for k, v in REASONING_VALUES.items()) + " FROM e)"


def _norm(k):
    return f"least(1, {k} / {max(L.REASONING_THRESHOLDS[k][1], 1e-9)}::DOUBLE)"


SCORE = "round(greatest(0, least(1, " + " + ".join(f"{w}::DOUBLE * {_norm(k)}" for k, w in L.REASONING_WEIGHTS.items()) + f" + 0.08::DOUBLE * greatest(0, 1 - {_norm('intuition_leap_density')}))), 4)"
SERVICE = "round(greatest(0, least(1, 0.4::DOUBLE * cot_scaffold_density * 10 + 0.4::DOUBLE * backtracking_density * 10 - 0.2::DOUBLE * intuition_leap_density * 10)), 6)"
SIGNALS = [*L.REASONING_WEIGHTS, "intuition_leap_density"]


def _top(cte, table, names, value, k):
    return f"""{cte}, u AS (SELECT doc_id, unnest(range(0, {len(names)})) AS i, unnest({names}) AS feature, unnest([{', '.join(map(value, names))}]) AS value FROM {table})
        SELECT doc_id, feature, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, i) AS k FROM u) WHERE k <= {k}"""


# hallucination: sentences end where L.GUARDED_STOP says, of which only the digit and letter rules meet lower-cased text
MARKED = r"regexp_replace(regexp_replace(regexp_replace(low || ' ', '\.{3,}|[!?]+', chr(1), 'g'), '([^0-9])\.([^0-9a-z])', '\1' || chr(1) || '\2', 'g'), '([^0-9])\.([^0-9a-z])', '\1' || chr(1) || '\2', 'g')"
OVER = "len(list_distinct(list_intersect(st[i], st[i + 1])))"
H_CTE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents),
e AS (SELECT *, {WORD} AS w, list_filter(list_transform(string_split({MARKED}, chr(1)), lambda s: regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+')), lambda s: len(s) > 0) AS st, regexp_extract_all(text, '{L.NUMBER}') AS numbers FROM d),
f AS (SELECT *, greatest(len(w), 1) AS n, list_transform(range(1, len(st)), lambda i: {OVER} / (len(list_distinct(st[i])) + len(list_distinct(st[i + 1])) - {OVER})) AS sims, list_transform(st, lambda s: len(s)) AS sl, {COUNTS % ('(' + GRAMS % dict(w='w', n=4) + ')')} AS four,
 {GRAMS % dict(w='w', n=2)} AS g2, len(list_filter(w, lambda x: x IN {_in(L.HEDGING)})) AS hedge, len(list_filter(w, lambda x: x IN {_in(L.ABSOLUTE)})) AS absolute, len(regexp_extract_all(low, '{L.SPECIFIC_DATE}')) AS specific, len(regexp_extract_all(low, '{L.VAGUE_TIME}')) AS vague FROM e)"""


def _share(words):
    return f"len(list_filter(w, lambda x: x IN {_in(words)})) / n"


H_VALUES = {
    **dict.fromkeys(features.HALLUCINATION, "0"),
    "hedging_ratio": "hedge / n",
    "overconfidence_ratio": "absolute / n",
    "negation_ratio": _share(L.NEGATION),
    "unigram_entropy": "if(len(w) > 0, list_aggregate(w, 'entropy'), 0)",
    "bigram_entropy": "if(len(g2) > 0, list_aggregate(g2, 'entropy'), 0)",
    "avg_jaccard_similarity": "if(len(st) >= 2, list_avg(sims), 1)",
    "min_jaccard_similarity": "if(len(st) >= 2, list_min(sims), 1)",
    "max_semantic_drop": "if(len(st) >= 3, list_max(list_transform(range(1, len(sims)), lambda i: sims[i] - sims[i + 1])), 0)",
    "disconnected_sentences_ratio": "if(len(st) >= 2, len(list_filter(sims, lambda x: x = 0)) / len(sims), 0)",
    "vague_quantifier_ratio": _share(L.VAGUE),
    "assertive_hedged_ratio": "absolute / greatest(absolute + hedge, 1)",
    "self_referential_ratio": "(" + " + ".join(rf"len(regexp_extract_all(low, '\b{p}\b'))" for p in L.SELF_REFERENCE) + ") / greatest(len(st), 1)",
    "phrase_repetition_rate": "if(len(w) >= 4, len(list_filter(four, lambda x: x > 1)) / (len(w) - 3), 0)",
    "sentence_length_uniformity": "if(len(st) >= 2, 1 - least(list_aggregate(sl, 'stddev_pop') / greatest(list_avg(sl), 1), 1), 0.5)",
    "modal_verb_ratio": _share(L.MODAL),
    "superlative_ratio": _share(L.SUPERLATIVE),
    "numeric_precision_ratio": "len(list_filter(numbers, lambda x: contains(x, '.') OR length(replace(x, '.', '')) >= 4)) / greatest(len(numbers), 1)",
    "temporal_specificity": "if(specific + vague > 0, specific / (specific + vague), 0.5)",
}
LONG = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20"
H = H_CTE + ", h AS (SELECT doc_id, " + ", ".join(f"if({LONG}, {H_VALUES[k]}, 0)::DOUBLE AS {k}" for k in features.HALLUCINATION) + " FROM f)"


def _h(*names):
    return f"{H} SELECT doc_id, " + ", ".join(f"round({k}, 6) AS {a}" for k, a in names) + " FROM h"


CATEGORIES = {
    "lexical_risk": "(hedging_ratio + overconfidence_ratio + negation_ratio) / 3",
    "entity_anomaly": "(entity_density + (1 - unique_entity_ratio) + entity_repetition_rate) / 3",
    "entropy": "(least(unigram_entropy / 10, 1) + least(bigram_entropy / 10, 1)) / 2",
    "semantic_incoherence": "((1 - avg_jaccard_similarity) + max_semantic_drop + disconnected_sentences_ratio) / 3",
    "vagueness": "(vague_quantifier_ratio + (1 - specificity_score) + (1 - assertive_hedged_ratio)) / 3",
    "repetition": "(self_referential_ratio + entity_repetition_rate + phrase_repetition_rate) / 3",
    "structural_anomaly": "(sentence_length_uniformity + modal_verb_ratio + superlative_ratio) / 3",
    "imprecision": "((1 - numeric_precision_ratio) + (1 - temporal_specificity)) / 2",
}
RISK = "greatest(0, least(1, " + " + ".join(f"({CATEGORIES[k]}) * {w}::DOUBLE" for k, w in L.RISK_WEIGHTS.items()) + "))"

# paragraphs of a text whose line ends are doubled
PARAGRAPH = rf"""WITH p AS (SELECT doc_id, len({WS % "replace(text, chr(10), chr(10) || chr(10))"}) AS n, list_transform(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: regexp_matches(s, '\S')), lambda s: len({WS % 's'})) AS pl FROM documents)
    SELECT doc_id, round(if(n >= 20 AND len(pl) >= 2, list_aggregate(pl, 'stddev_samp') / greatest(list_avg(pl), 1e-9), 0), 6) AS cv FROM p"""

HYBRID = f"""WITH w AS (SELECT doc_id, {WS % 'text'} AS w FROM documents), x AS (SELECT doc_id, i, {SENT % "array_to_string(w[i + 1:i + 100], ' ')"} AS ss FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 100) + 1, 40)) AS i FROM w WHERE len(w) > 0)),
    y AS (SELECT doc_id, i, list_transform(ss, lambda s: len({WS % 's'})) AS n FROM x), z AS (SELECT doc_id, i, len(n) AS k, list_avg(n) AS m, list_aggregate(n, 'stddev_pop') AS s FROM y)
    SELECT doc_id, CAST(i AS BIGINT) AS start, round(if(k < 3, 0, (s - m) / (s + m)), 6) AS burstiness FROM z"""

CITED = """CASE WHEN doc_id % 3 < 1 THEN 0.0 ELSE round(((CASE WHEN doc_id % 100 < 40 THEN 1.0 WHEN doc_id % 100 < 70 THEN 0.5 ELSE 0 END) + (CASE WHEN doc_id % 10 / 20 > 0.3::DOUBLE THEN 1.0 WHEN doc_id % 10 / 20 > 0.1::DOUBLE THEN 0.5 ELSE 0 END)
    + (CASE WHEN doc_id % 7 / 10 > 0.5::DOUBLE THEN 1.0 WHEN doc_id % 7 / 10 > 0.2::DOUBLE THEN 0.5 ELSE 0 END))::DOUBLE / 4, 4) END"""

BASELINE = {"perplexity": ("(40 + doc_id % 30)::DOUBLE", 55.0), "burstiness": ("(0.1::DOUBLE + doc_id % 5 / 20)", 0.25), "lexical_diversity": ("(0.5::DOUBLE + doc_id % 6 / 20)", 0.70), "sentence_length": ("(10 + doc_id % 15)::DOUBLE", 16.0), "grade": (f"({FK_VALUE})::DOUBLE", 10.0)}


# attacks
def _draw(i, name):
    y = f"(((doc_id % 1000003) * 7919 + ({i}) * 104729 + {zlib.crc32(name.encode())}) % 1000003)"
    return f"(({y} * ({y} + 12345)) % 999983 % 10000)"


CHARS = "regexp_extract_all(text, '(?s).')"
INVERSE = corpus.inverse_confusables()


def _each_char(name, change, rate, text="text"):
    return f"array_to_string(list_transform({CHARS.replace('text', text)}, lambda c, i: CASE WHEN {_draw('i - 1', name)} < {int(rate * 10_000)} THEN {change} ELSE c END), '')"


def _homoglyph(rate, name="homoglyph", text="text"):
    return _each_char(name, f"translate(c, '{INVERSE[0]}', '{INVERSE[1]}')", rate, text)


def _noise(rate, name="char_noise"):
    j = f"({_draw('i - 1', name + ' at')} % (length(x) - 1))"
    swapped = f"substr(x, 1, {j}) || substr(x, {j} + 2, 1) || substr(x, {j} + 1, 1) || substr(x, {j} + 3)"
    return f"array_to_string(list_transform({WS % 'text'}, lambda x, i: CASE WHEN length(x) > 4 AND {_draw('i - 1', name)} < {int(rate * 10_000)} THEN {swapped} ELSE x END), ' ')"


ATTACKS = {
    "homoglyph": _homoglyph(0.5),
    "zero_width": _each_char("zero_width", "c || chr(8203)", 0.1),
    "char_noise": _noise(0.1),
    "whitespace": _each_char("whitespace", "CASE WHEN c = ' ' THEN '   ' ELSE c END", 0.1),
}

# attribution: a word's indicator moves the text's score
def _scored(score):
    """Of w, a text's words: those that have a letter to show, with place and score."""
    known = lambda m: f"map_extract(map({list(m)}, {list(m.values())}::DOUBLE[]), regexp_replace(lower(w[i]), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', '', 'g'))[1]"
    moved = f"CASE WHEN {known(report.AI_WORDS)} IS NOT NULL THEN least(1, {score}::DOUBLE + {known(report.AI_WORDS)} * 0.3::DOUBLE) WHEN {known(report.HUMAN_WORDS)} IS NOT NULL THEN greatest(0, {score}::DOUBLE - {known(report.HUMAN_WORDS)} * 0.3::DOUBLE) ELSE {score}::DOUBLE END"
    return f"list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i - 1, 'n': length(translate(w[i], '{L.ZERO_WIDTH_ATTRIBUTION}', '')), 's': greatest(0, least(1, ({moved}) * (1 - (i - 1) / len(w) * 0.1::DOUBLE)))}}), lambda x: x.n > 0)"


def _words(score):
    return f"WITH w AS (SELECT doc_id, {WS % 'text'} AS w FROM documents), s AS (SELECT doc_id, {_scored(score)} AS s FROM w)"


def sentence_sql(score):
    """Table m: doc_id, position, score and marks of every sentence."""
    marks = [f"CASE WHEN contains(lower(s), '{w}') THEN 'AI indicator: ' || chr(39) || '{w}' || chr(39) END" for w, x in report.AI_WORDS.items() if x > 0.7]
    marks += [rf"CASE WHEN regexp_matches(lower(s), '\b(first|second|third|finally)\b') THEN 'Sequential structure' END", rf"CASE WHEN regexp_matches(lower(s), '\b(therefore|thus|hence|consequently)\b') THEN 'Logical connector' END"]
    return f"""WITH t AS (SELECT doc_id, {SENT % 'text'} AS ss FROM documents), u AS (SELECT doc_id, unnest(range(0, len(ss))) AS position, unnest(ss) AS s FROM t), w AS (SELECT *, {WS % 's'} AS w FROM u),
        m AS (SELECT doc_id, position, coalesce(list_avg(list_transform({_scored(score)}, lambda x: x.s)), 0) AS score, list_filter([{', '.join(marks)}], lambda x: x IS NOT NULL) AS marks FROM w)"""


def _canonical(text):
    bare = f"regexp_replace({text}, '{ZW}', '', 'g')"
    joined = rf"regexp_replace(regexp_replace(regexp_replace({FOLD % bare}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({joined}, '\s{{2,}}', ' ', 'g'), '\s+([,.;:?!])', '\1', 'g'), '^\s+|\s+$', '', 'g')"

# the appended bibliography is the only one: documents have no such header
CITING = f"WITH t AS (SELECT doc_id, {BIB} AS t FROM documents), b AS (SELECT doc_id, substr(t, 1, strpos(t, chr(10) || 'References' || chr(10))) AS body, substr(t, strpos(t, chr(10) || 'References' || chr(10)) + 11) AS bib FROM t)"
INLINE = f"list_concat(regexp_extract_all(body, '{citations.PAREN}', 1), list_transform(list_zip(regexp_extract_all(body, '{citations.AUTHOR_YEAR}', 1), regexp_extract_all(body, '{citations.AUTHOR_YEAR}', 2)), lambda x: trim(x[1]) || ', ' || x[2]))"
APA = citations.APA

WINDOWS7 = f"""WITH s AS (SELECT doc_id, {CAPITAL} AS s FROM documents), n AS (SELECT doc_id, list_transform(s, lambda x: len({WS % 'x'})) AS n FROM s)
    SELECT doc_id, CAST(CASE WHEN len(n) < 3 THEN 1 ELSE greatest(1, len(list_filter(range(0, len(n), 5), lambda i: list_sum(n[i + 1:i + 7]) >= 64))) END AS BIGINT) AS n FROM n"""

# perplexity: each window of sentences with its own n-grams, then the features of all windows
W7 = rf"""WITH a AS (SELECT doc_id, text, len({WS % 'text'}) AS nw, list_transform({CAPITAL}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS s FROM documents),
    b AS (SELECT doc_id, s, list_filter(list_transform(range(0, len(s), 5), lambda i: array_to_string(s[i + 1:i + 7], ' ')), lambda x: len({WS % 'x'}) >= 64) AS k FROM a),
    win AS (SELECT doc_id, CASE WHEN len(s) < 3 OR len(k) = 0 THEN [array_to_string(s, ' ')] ELSE k END AS win FROM b)"""
ENT_OF = "list_transform(CASE WHEN len(w) <= 50 THEN [w] ELSE list_transform(range(0, len(w) - 49, 25), lambda i: w[i + 1:i + 50]) END, lambda y: CASE WHEN len(y) = 0 THEN 0 ELSE list_aggregate(y, 'entropy') END)"
PERPLEXITY = f"""{W7}, d AS (SELECT doc_id, i, {WORD} AS w FROM (SELECT doc_id, unnest(range(0, len(win))) AS i, unnest(win) AS text FROM win)), {ppl_cte('doc_id, i')},
    v AS (SELECT doc_id, list(ppl::DOUBLE ORDER BY i) AS v FROM p GROUP BY doc_id), t AS (SELECT doc_id, nw, {WORD} AS w FROM a), u AS (SELECT doc_id, nw, len(w) AS n, v, {ENT_OF} AS x, list_avg(v) AS mu, list_aggregate(v, 'stddev_pop') AS sd, len(list_filter(v, lambda q: q < 7)) / len(v) AS low FROM t JOIN v USING (doc_id)),
    z AS (SELECT doc_id, n, {', '.join(f'CASE WHEN nw >= 15 THEN {value} ELSE 0 END::DOUBLE AS {k}' for k, value in {
        "proxy_perplexity_mean": "mu", "proxy_perplexity_std": "sd", "perplexity_curve_slope": "CASE WHEN len(v) > 1 THEN list_sum(list_transform(range(0, len(v)), lambda i: (i - (len(v) - 1) / 2) * v[i + 1])) / (len(v) * (len(v) * len(v) - 1) / 12) ELSE 0 END",
        "low_perplexity_ratio": "low", "perplexity_valley_count": "len(list_filter(range(1, len(v) + 1), lambda i: v[i] < 7 AND (i = 1 OR v[i - 1] >= 7)))", "perplexity_range": "list_max(v) - list_min(v)", "token_entropy_mean": "list_avg(x)", "token_entropy_std": "list_aggregate(x, 'stddev_pop')",
        "burstiness_perplexity": "CASE WHEN mu > 0 THEN sd / mu ELSE 0 END", "curvature_score": "0", "smoothing_factor": "CASE WHEN n > 0 THEN 1 / n ELSE 0 END", "hybrid_segment_ratio": "low"}.items())} FROM u)"""


def _vote(value, high, medium):
    return f"CASE WHEN {value} {high}::DOUBLE THEN 1.0::DOUBLE WHEN {value} {medium}::DOUBLE THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"


VOTES = [
    _vote("proxy_perplexity_mean", "< 4.0", "< 7.0"), _vote("token_entropy_mean", "< 3.0", "< 4.5"), _vote("burstiness_perplexity", "< 0.05", "< 0.15"),
    _vote("low_perplexity_ratio", "> 0.7", "> 0.3"), _vote("perplexity_valley_count", ">= 3", ">= 1"),
]


def _cited(least):
    """Table s: a document's references as q (year, doi, first surname), their scores, and its citations as c."""
    n = WS % "t"
    return f"""{CITING}, w AS (SELECT doc_id, len({n}) AS n FROM t), r AS (SELECT b.doc_id, CASE WHEN n < {least} THEN [] ELSE regexp_extract_all(bib, '{APA}') END AS r, lower(array_to_string({INLINE}, chr(10))) AS c FROM b JOIN w USING (doc_id)),
        q AS (SELECT doc_id, c, list_transform(r, lambda x: {{'y': CAST(substr(regexp_extract(x, '{APA}', 2), 1, 4) AS INT), 'd': regexp_extract(x, '{citations.DOI}', 1), 'a': lower(regexp_extract(trim(regexp_extract(x, '{APA}', 1)), '([A-Za-z-]{{2,}})', 1))}}) AS q FROM r),
        s AS (SELECT doc_id, q, c, list_transform(q, lambda x: greatest(0.0, CASE WHEN x.y > 2026 OR x.y < 1900 THEN 20.0 ELSE 50.0 END - CASE WHEN x.d <> '' AND NOT regexp_matches(x.d, '^10\\.\\d{{4,}}/\\S+$') THEN 20.0 ELSE 0.0 END)::DOUBLE) AS scores,
            CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda x: x.a <> '' AND NOT contains(c, x.a))) / len(q) ELSE 0 END::DOUBLE AS missing FROM q)"""


TOKEN = r"[\p{L}\p{N}\p{M}_]"
TAG = "CASE " + " ".join(f"WHEN regexp_full_match(t, '{rule.replace(chr(92) + 'w', TOKEN)}') THEN '{name}'" for rule, name in L.TAGS) + " ELSE 'NOUN' END"

SQL = {
    "fn_pos_fallback": rf"""WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}+|[^\p{{L}}\p{{N}}\p{{M}}_\s]') AS ts FROM documents), u AS (SELECT doc_id, unnest(ts) AS t FROM a), g AS (SELECT doc_id, {TAG} AS tag FROM u)
        SELECT documents.doc_id, count(*) FILTER (tag = 'VERB') AS n_verb, count(*) FILTER (tag = 'DET') AS n_det FROM documents LEFT JOIN g USING (doc_id) GROUP BY documents.doc_id""",
    "agg_ref_features": f"{_cited(50)} SELECT doc_id, len(q)::DOUBLE AS total_references, coalesce(list_avg(scores), 0)::DOUBLE AS mean_confidence, coalesce(list_min(scores), 0)::DOUBLE AS min_confidence, len(list_filter(q, lambda x: x.y > 2026 OR x.y < 1900))::DOUBLE AS date_anomaly_count, missing AS missing_inline_ratio FROM s",
    "jn_bib_inline": f"{_cited(0)} SELECT doc_id, round(missing, 6) AS missing FROM s",
    "fn_attr_sent": f"{sentence_sql(0.6)} SELECT doc_id, CAST(position AS INT) AS position, round(score, 6) AS score, array_to_string(marks, '|') AS indicators FROM m",
    "fn_attr_word": f"{_words(0.6)} SELECT doc_id, CAST(len(s) AS BIGINT) AS n, round(coalesce(list_avg(list_transform(s, lambda x: x.s)), 0), 6) AS mean FROM s",
    "sink_png_charts": f"{_words(0.5)}, u AS (SELECT doc_id, unnest(s[1:200]) AS x FROM s) SELECT doc_id, CAST(x.i AS INT) AS position, round(x.s, 6) AS score FROM u",
    "nrm_canonical": f"SELECT doc_id, md5({_canonical(SPOILED_SQL)}) AS canonical FROM documents",
    "win_sentences7": WINDOWS7,
    "tf_bib_split": f"{CITING} SELECT doc_id, CAST(length(body) AS BIGINT) AS body, CAST(length(bib) AS BIGINT) AS bib FROM b",
    "tf_inline": f"{CITING}, i AS (SELECT doc_id, {INLINE} AS l FROM b) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS cites FROM i",
    "tf_apa": f"""{CITING}, r AS (SELECT doc_id, regexp_extract_all(bib, '{APA}') AS r FROM b), u AS (SELECT doc_id, unnest(range(0, len(r))) AS position, unnest(r) AS r FROM r)
        SELECT doc_id, CAST(position AS INT) AS position, CAST(substr(regexp_extract(r, '{APA}', 2), 1, 4) AS INT) AS year, regexp_replace(trim(regexp_extract(r, '{APA}', 3)), '[.]+$', '') AS title, regexp_extract(r, '{citations.DOI}', 1) AS doi FROM u""",
    "fn_risk_r": f"{R}, q AS (SELECT doc_id, {SCORE} AS score, {SERVICE} AS service FROM r) SELECT doc_id, score, CASE WHEN score >= 0.55 THEN 'HIGH' WHEN score >= 0.28 THEN 'MEDIUM' ELSE 'LOW' END AS level, service FROM q",
    "fn_risk_r_service": f"{R} SELECT doc_id, {SERVICE} AS score FROM r",
    "fn_level_r": f"{R} SELECT doc_id, " + ", ".join(f"CASE WHEN {k} >= {hi}::DOUBLE THEN 'high' WHEN {k} >= {lo}::DOUBLE THEN 'medium' ELSE 'low' END AS {k}" for k, (lo, hi) in L.REASONING_THRESHOLDS.items()) + " FROM r",
    "top_signals_r": _top(R, "r", SIGNALS, _norm, 5),
    "feat_hallucination": _h(*((k, k) for k in features.HALLUCINATION)),
    "fn_temporal": _h(("temporal_specificity", "specificity")),
    "fn_uniformity": _h(("sentence_length_uniformity", "uniformity")),
    "win_sent_jaccard": _h(*((k, k) for k in ("avg_jaccard_similarity", "min_jaccard_similarity", "max_semantic_drop", "disconnected_sentences_ratio"))),
    "top_signals_h": _top(H, "h", features.HALLUCINATION, str, 3),
    "fn_risk_h": f"{H}, q AS (SELECT doc_id, {RISK} AS s FROM h) SELECT doc_id, round(s, 4) AS score, CASE WHEN s < 0.25 THEN 'LOW' WHEN s < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM q",
    "fn_level_h": f"{H}, q AS (SELECT doc_id, unnest({list(CATEGORIES)}) AS category, unnest([{', '.join(CATEGORIES.values())}]) AS v FROM h) SELECT doc_id, category, CASE WHEN v >= 0.6::DOUBLE THEN 'high' WHEN v >= 0.3::DOUBLE THEN 'medium' ELSE 'low' END AS level FROM q",
    "agg_paragraph_cv": PARAGRAPH,
    "win_hybrid100": HYBRID,
    "fn_baseline": f"{FK_WHOLE}, b AS (SELECT doc_id, unnest({list(BASELINE)}) AS metric, unnest([{', '.join(v for v, _ in BASELINE.values())}]) AS value, unnest({[h for _, h in BASELINE.values()]})::DOUBLE AS human FROM y) SELECT doc_id, metric, value, abs(value - human) / human > 0.30::DOUBLE AS deviates FROM b",
    "prj_fk_prefix": f"{FK_CTE}, z AS (SELECT doc_id, {FK_VALUE} AS fk FROM y) SELECT doc_id, md5('[FK_SCORE: ' || printf('%.1f', CASE WHEN fk = 0 THEN 0.0 ELSE fk END) || '] ' || coalesce(text, '')) AS prefixed FROM z JOIN documents USING (doc_id)",
    "jn_group_calib": f"""WITH {S}, c AS ({CONFORMAL.format(g='CAST(NULL AS VARCHAR)')} UNION ALL {CONFORMAL.format(g='lang')} GROUP BY lang HAVING count(*) >= 50)
        SELECT doc_id, coalesce(c.tau_ai, z.tau_ai) AS tau_ai FROM s LEFT JOIN c ON c.grp = s.lang CROSS JOIN (SELECT * FROM c WHERE grp IS NULL) z""",
    **{f"atk_{k}": f"WITH a AS (SELECT doc_id, text, {v} AS a FROM documents) SELECT doc_id, md5(a) AS attacked, CAST(length(a) - length(text) AS INT) AS grown FROM a" for k, v in ATTACKS.items()},
    "aug_v7": f"""WITH a AS (SELECT doc_id, CASE WHEN {_draw('0', 'apply')} < 5000 THEN {_noise(0.05, 'aug noise')} ELSE text END AS a FROM documents),
        b AS (SELECT doc_id, CASE WHEN {_draw('0', 'apply')} < 5000 AND {_draw('0', 'glyphs')} < 1500 THEN {_homoglyph(0.3, 'aug glyph', 'a')} ELSE a END AS b FROM a) SELECT doc_id, md5(b) AS augmented FROM b""",
    "jn_lsh_band": MINHASH_SQL[: MINHASH_SQL.rindex("SELECT doc_id, md5")].rstrip() + """, b AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, p // 4 AS b, string_agg(CAST(m AS VARCHAR), ',' ORDER BY p) AS k FROM s GROUP BY 1, 2))
        SELECT n, count(*) AS bands FROM (SELECT k, count(*) AS n FROM b GROUP BY k HAVING count(*) > 1) GROUP BY n""",
    "set_dedup_near": MINHASH_SQL[: MINHASH_SQL.rindex("SELECT doc_id, md5")].rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT doc_id, p // 4 AS b, hash(string_agg(CAST(m AS VARCHAR), ',' ORDER BY p)) AS k FROM s GROUP BY 1, 2),
        dd AS MATERIALIZED (SELECT doc_id, list(DISTINCT k) AS ks, row_number() OVER (ORDER BY doc_id) AS i FROM b JOIN documents USING (doc_id) WHERE regexp_matches(text, '\\S') GROUP BY doc_id),
        r(i, taken, stays) AS (SELECT CAST(0 AS BIGINT), CAST([] AS UBIGINT[]), false UNION ALL SELECT dd.i, CASE WHEN list_has_any(taken, ks) THEN taken ELSE list_concat(taken, ks) END, NOT list_has_any(taken, ks) FROM r JOIN dd ON dd.i = r.i + 1)
        SELECT doc_id FROM dd JOIN r USING (i) WHERE stays""",
    "sink_profile_json": f"WITH d AS (SELECT source, CASE WHEN {LONG} THEN length(array_to_string({WORD}, '')) / greatest(len({WORD}), 1) ELSE 0 END AS x FROM documents) SELECT source AS author, count(*) AS n, round(avg(x), 4) AS word_length FROM d GROUP BY source",
    "jn_plugin_merge": f"""SELECT doc_id, r.level, h.level AS hallucination_level, 0 AS n_errors FROM ({R}, q AS (SELECT doc_id, {SCORE} AS score FROM r) SELECT doc_id, CASE WHEN score >= 0.55 THEN 'HIGH' WHEN score >= 0.28 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM q) r
        JOIN ({H}, q AS (SELECT doc_id, {RISK} AS s FROM h) SELECT doc_id, CASE WHEN s < 0.25 THEN 'LOW' WHEN s < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM q) h USING (doc_id)""",
    "feat_perplexity": f"{PERPLEXITY} SELECT doc_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in features.PERPLEXITY) + " FROM z",
    "fn_risk_p": f"""{PERPLEXITY}, q AS (SELECT doc_id, n, ({' + '.join(VOTES)}) / 5.0::DOUBLE AS raw FROM z) SELECT doc_id, CASE WHEN n < 15 THEN 0.0 ELSE round(greatest(0, least(1, CASE WHEN n < 300 THEN 0.5 + (raw - 0.5) * n / 300.0::DOUBLE ELSE raw END)), 4) END::DOUBLE AS score FROM q""",
}
