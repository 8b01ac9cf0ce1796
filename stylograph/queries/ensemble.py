"""Ensemble, thresholds and metrics. No model runs here: logits and scores are stated functions of doc_id, named synthetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import corpus, ensemble, metrics
from .text import docs

LOGIT = "((doc_id * 31 + {m} * 17 + {c} * 101 + doc_id * {c} * ({m} + 1)) % 97) / 16.0"
PROB_SQL = f"""l AS (SELECT doc_id, m, c, {LOGIT.format(m='m', c='c')} AS z FROM documents, range(0, 3) a(m), range(0, 7) b(c)),
p AS (SELECT doc_id, m, c, exp(z) / sum(exp(z)) OVER (PARTITION BY doc_id, m) AS p, row_number() OVER (PARTITION BY doc_id, m ORDER BY z DESC, c) AS r FROM l),
q AS (SELECT doc_id, c, round(avg(p), 12) AS p FROM p GROUP BY ALL),
v AS (SELECT doc_id, avg(CASE WHEN c <> 0 THEN 1.0 ELSE 0.0 END) AS votes FROM p WHERE r = 1 GROUP BY ALL),
g AS (SELECT doc_id, list(p ORDER BY c) AS ps FROM q GROUP BY doc_id)"""


def synthetic_logits(spark, d):
    one = lambda m: F.array(*(F.expr(LOGIT.format(m=m, c=c)).cast("double") for c in range(7)))
    return docs(spark, d).select("doc_id", F.explode(F.array(*(F.struct(F.lit(f"m{m}").alias("model"), one(m).alias("logits")) for m in range(3)))).alias("x")).select("doc_id", "x.model", "x.logits")


def _votes(spark, d):
    return ensemble.soft_vote(synthetic_logits(spark, d))


def _soft_vote(spark, d):
    return _votes(spark, d).select("doc_id", F.posexplode("probs").alias("c", "p")).select("doc_id", F.col("c").cast("long").alias("c"), F.round("p", 6).alias("p"))


def _gates(profile):
    def query(spark, d):
        v = _votes(spark, d)
        return v.select("doc_id", ensemble.gates(F.col("probs"), F.col("votes_ai"), F.col("agree_top"), profile).alias("g")).select("doc_id", "g.verdict")

    least, agree, gap, low, high = L.PROFILES[profile]
    sql = f"""WITH {PROB_SQL} SELECT doc_id, CASE WHEN ps[1] BETWEEN {low} AND {high} THEN 'INCONCLUSIVE' WHEN 1 - ps[1] < {least} THEN 'HUMAN'
        WHEN votes >= {agree} AND list_reverse_sort(ps)[1] - list_reverse_sort(ps)[2] >= {gap} THEN 'AI_DETECTED' ELSE 'INCONCLUSIVE' END AS verdict FROM g JOIN v USING (doc_id)"""
    return query, sql


def _sentence_verdicts(spark, d):
    base = docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 12).cast("int"))).alias("i"))
    h = (F.col("doc_id") * 7 + F.col("i") * 5) % 10
    return base.select("doc_id", F.when(h < 5, "AI_DETECTED").when(h < 8, "HUMAN").otherwise("INCONCLUSIVE").alias("verdict"), F.when(h < 2, "GPT").otherwise("Claude").alias("ai_model"))


DOC_SQL = """WITH s AS (SELECT doc_id, (doc_id * 7 + i * 5) % 10 AS h FROM (SELECT doc_id, unnest(range(0, CAST(doc_id % 12 AS BIGINT) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (h < 5) AS ai, count(*) FILTER (h >= 5 AND h < 8) AS human FROM s GROUP BY ALL)
SELECT doc_id, n AS n_sentences, CASE WHEN n >= 3 THEN ai ELSE 0 END AS n_ai, CASE WHEN n >= 3 THEN human ELSE 0 END AS n_human, CASE WHEN n >= 3 THEN n - ai - human ELSE 0 END AS n_inconclusive,
CASE WHEN n >= 3 THEN round(ai / n, 3) ELSE 0.0 END AS ai_ratio, CASE WHEN n >= 3 THEN round(human / n, 3) ELSE 1.0 END AS human_ratio,
CASE WHEN n < 3 THEN 'insufficient_data' WHEN ai / n > 0.85 OR ai / n < 0.10 THEN 'high' WHEN ai / n > 0.70 OR ai / n < 0.20 THEN 'moderate' ELSE 'low' END AS confidence FROM c"""


def scores(spark, d):
    """doc_id, lang, y (a label of documents), p (synthetic), pred."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    p = (F.col("doc_id") * 7919 % 1000 / 1000.0 + F.col("y") * 0.35) / 1.35
    return labels.join(docs(spark, d).select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "y", p.alias("p"), (p >= 0.5).cast("int").alias("pred"))


S = "s AS (SELECT doc_id, lang, toxic AS y, (doc_id * 7919 % 1000 / 1000.0::DOUBLE + toxic * 0.35::DOUBLE) / 1.35::DOUBLE AS p FROM labels JOIN documents USING (doc_id)), t AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM s)"


def _rounded(df, *keys):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def _conformal(group):
    return lambda s, d: _rounded(ensemble.conformal(scores(s, d), 0.05, group, 50 if group else 0))


CONFORMAL = """SELECT {g} AS grp, count(*) AS n, round(list(p ORDER BY p)[least(count(*), greatest(1, CAST(ceil((count(*) + 1) * 0.95 - 1e-9) AS BIGINT)))], 6) AS tau_ai, round(quantile_cont(p, 0.5), 6) AS tau_human FROM s WHERE y = 0"""


def _decide(spark, d):
    s = scores(spark, d)
    t = ensemble.with_thresholds(s, ensemble.conformal(s, 0.05, "lang", 50), "lang")
    return t.select("doc_id", ensemble.conformal_decide(F.col("p"), F.col("tau_ai"), F.col("tau_human")).alias("verdict"))


def _temperature(spark, d):
    logits = synthetic_logits(spark, d).filter("model = 'm0'")
    t = ensemble.fit_temperature(logits, docs(spark, d).select("doc_id", (F.col("doc_id") % 7).cast("int").alias("label")))
    return spark.createDataFrame([(float(t),)], "temperature double")


def _canonical_drop(spark, d):
    """What each attack takes from a score (the share of function words), and what is left of that once texts are made canonical."""
    from ..functions import columns as C

    def score(text):
        return C.let(C.tok_word(text), lambda w: C.share_in(w, L.FUNCTION_WORDS) / F.greatest(F.size(w), F.lit(1)))

    drops = corpus.score_drops(docs(spark, d).select("doc_id", "text"), ("homoglyph", "zero_width", "char_noise", "whitespace"), score, C.canonical)
    return drops.select("attack", *(F.round(c, 5).alias(c) for c in ("plain", "attacked", "lost", "left")))


ALL = {
    "agg_soft_vote": (_soft_vote, f"WITH {PROB_SQL} SELECT doc_id, c, round(p, 6) AS p FROM q"),
    "agg_votes": (lambda s, d: _votes(s, d).select("doc_id", F.round("votes_ai", 6).alias("votes")), f"WITH {PROB_SQL} SELECT doc_id, round(votes, 6) AS votes FROM v"),
    "fn_softmax": (
        lambda s, d: synthetic_logits(s, d).select("doc_id", "model", F.posexplode(ensemble.softmax(F.col("logits"), 1.7)).alias("c", "p")).select("doc_id", "model", F.col("c").cast("long").alias("c"), F.round("p", 6).alias("p")),
        f"WITH {PROB_SQL} SELECT doc_id, 'm' || m AS model, c, round(exp(z / 1.7) / sum(exp(z / 1.7)) OVER (PARTITION BY doc_id, m), 6) AS p FROM l",
    ),
    "fn_two_stage": (
        lambda s, d: _votes(s, d).select("doc_id", ensemble.two_stage(F.col("probs")).alias("t")).select("doc_id", F.round("t.p_human", 6).alias("p_human"), F.round("t.p_ai", 6).alias("p_ai"), "t.top_ai_model"),
        f"WITH {PROB_SQL} SELECT doc_id, round(ps[1], 6) AS p_human, round(1 - ps[1], 6) AS p_ai, {L.LABELS_V6}[1 + list_position(ps[2:7], list_max(ps[2:7]))] AS top_ai_model FROM g",
    ),
    "top_margin": (
        lambda s, d: _votes(s, d).select("doc_id", F.round(ensemble.margin(F.col("probs")), 6).alias("margin"), ensemble.argmax(F.col("probs")).alias("top")),
        f"WITH {PROB_SQL} SELECT doc_id, round(list_reverse_sort(ps)[1] - list_reverse_sort(ps)[2], 6) AS margin, CAST(list_position(ps, list_max(ps)) - 1 AS INT) AS top FROM g",
    ),
    **{f"fn_gates_{p}": _gates(p) for p in L.PROFILES},
    "agg_doc_sentences": (lambda s, d: ensemble.document_verdict(_sentence_verdicts(s, d)).drop("dominant_ai_model"), DOC_SQL),
    "agg_conformal": (_conformal(None), f"WITH {S} " + CONFORMAL.format(g="CAST(NULL AS VARCHAR)")),
    "agg_conformal_group": (_conformal("lang"), f"WITH {S} " + CONFORMAL.format(g="CAST(NULL AS VARCHAR)") + " UNION ALL " + CONFORMAL.format(g="lang") + " GROUP BY lang HAVING count(*) >= 50"),
    "fn_conformal_decide": (
        _decide,
        f"""WITH {S}, c AS ({CONFORMAL.format(g='CAST(NULL AS VARCHAR)').replace('round(', '(').replace(', 6)', ')')} UNION ALL {CONFORMAL.format(g='lang').replace('round(', '(').replace(', 6)', ')')} GROUP BY lang HAVING count(*) >= 50),
            j AS (SELECT s.*, coalesce(c.tau_ai, z.tau_ai) AS a, coalesce(c.tau_human, z.tau_human) AS h FROM s LEFT JOIN c ON c.grp = s.lang CROSS JOIN (SELECT * FROM c WHERE grp IS NULL) z)
            SELECT doc_id, CASE WHEN p >= a THEN 'AI' WHEN p <= h THEN 'HUMAN' ELSE 'INCONCLUSIVE' END AS verdict FROM j""",
    ),
    "agg_confusion": (
        lambda s, d: _rounded(metrics.confusion(scores(s, d))),
        f"""WITH {S}, c AS (SELECT count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn FROM t)
            SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
            round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""",
    ),
    "agg_cm_matrix": (
        lambda s, d: scores(s, d).groupBy("y").pivot("pred", [0, 1]).count().select("y", F.coalesce("0", F.lit(0)).alias("n0"), F.coalesce("1", F.lit(0)).alias("n1")),
        f"WITH {S} SELECT y, count(*) FILTER (pred = 0) AS n0, count(*) FILTER (pred = 1) AS n1 FROM t GROUP BY y",
    ),
    "agg_weighted_f1": (
        lambda s, d: _rounded(metrics.weighted_f1(scores(s, d).withColumnsRenamed({"y": "label"}))),
        f"""WITH {S}, k AS (SELECT y, count(*) AS n, count(*) FILTER (pred = y) AS tp FROM t GROUP BY y), m AS (SELECT pred, count(*) AS n FROM t GROUP BY pred)
            SELECT round(sum(k.n * 2 * tp / (k.n + coalesce(m.n, 0))) / sum(k.n), 6) AS weighted_f1, round(sum(tp) / sum(k.n), 6) AS accuracy FROM k LEFT JOIN m ON m.pred = k.y""",
    ),
    "agg_auroc": (
        lambda s, d: _rounded(metrics.auroc(scores(s, d))),
        f"""WITH {S}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s), n AS (SELECT sum(y)::DOUBLE AS a, (count(*) - sum(y))::DOUBLE AS b FROM s)
            SELECT round((sum(r) FILTER (y = 1) - a * (a + 1) / 2) / (a * b), 6) AS auroc FROM r, n GROUP BY a, b""",
    ),
    "agg_tpr_at_fpr": (
        lambda s, d: _rounded(metrics.tpr_at_fpr(scores(s, d), 0.05)),
        f"WITH {S}, q AS (SELECT quantile_cont(p, 0.95) AS tau FROM s WHERE y = 0) SELECT round(tau, 6) AS tau, round(avg(CASE WHEN p >= tau THEN 1.0 ELSE 0.0 END), 6) AS tpr FROM s, q WHERE y = 1 GROUP BY tau",
    ),
    "agg_ece": (
        lambda s, d: _rounded(metrics.ece(scores(s, d))),
        f"""WITH {S}, b AS (SELECT least(floor(greatest(p, 1 - p) * 15), 14) AS c, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS a, avg(greatest(p, 1 - p)) AS k, count(*) AS n FROM t GROUP BY 1)
            SELECT round(sum(abs(a - k) * n) / sum(n), 6) AS ece FROM b""",
    ),
    "agg_fpr_by_group": (
        lambda s, d: _rounded(metrics.fpr_by_group(scores(s, d), "lang")),
        f"WITH {S} SELECT lang, count(*) FILTER (y = 0) AS n_human, round(avg(pred) FILTER (y = 0), 6) AS fpr, round(avg(pred) FILTER (y = 1), 6) AS tpr FROM t GROUP BY lang HAVING count(*) FILTER (y = 0) >= 10",
    ),
    "agg_class_counts": (lambda s, d: docs(s, d).groupBy("lang").agg(F.count("*").alias("n")), "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
    "agg_class_weight": (
        lambda s, d: _rounded(corpus.class_weights(docs(s, d), "lang")),
        "WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT *, sqrt(sum(n + 1) OVER () / (n + 1)) AS r FROM c) SELECT label, n, round(382720 / n, 6) AS w_v6, round(r / avg(r) OVER (), 6) AS w_v7 FROM r",
    ),
    "ml_temperature": (_temperature, None),
}
