"""Ensemble algebra over a table of logits (doc_id, model, logits array<double>): probabilities, votes, gates, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..session import Stage
from . import selection


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(logits, lambda z: z / t)
    return C.let(scaled, lambda z: C.let(F.transform(z, lambda x: F.exp(x - F.array_max(z))), lambda e: F.transform(e, lambda x: x / C.total(e))))


def argmax(p: Column) -> Column:
    """First index of the largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def margin(p: Column) -> Column:
    return C.let(F.sort_array(p, asc=False), lambda s: F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def soft_vote(logits: DataFrame, temperatures: DataFrame | None = None, classes: int = 7) -> DataFrame:
    """doc_id, probs (mean over models), votes_ai (share of models whose top class isn't Human), agree_top, n_models.

    agree_top: share of models whose top class is the likeliest AI class of the mean. temperatures: model, temperature. Means are
    rounded to 12 places, so that classes that tie do so in whatever order the models are added up.
    """
    t = logits if temperatures is None else logits.join(F.broadcast(temperatures), "model", "left")
    p = t.select("doc_id", softmax(F.col("logits"), F.coalesce("temperature", F.lit(1.0)) if temperatures is not None else 1.0).alias("p"))
    p = p.withColumn("top", argmax(F.col("p")))
    mean = p.groupBy("doc_id").agg(F.array(*(F.round(F.avg(F.get("p", F.lit(k))), 12) for k in range(classes))).alias("probs"), F.count("*").alias("n_models"), F.avg((F.col("top") != 0).cast("double")).alias("votes_ai"), F.array(*(F.avg((F.col("top") == k).cast("double")) for k in range(classes))).alias("top_share"))
    best = argmax(F.slice("probs", 2, classes - 1)) + 1
    return mean.select("doc_id", "probs", "votes_ai", F.get("top_share", best).alias("agree_top"), "n_models")


def two_stage(probs: Column, labels: list[str] = L.LABELS_V6) -> Column:
    """struct(p_human, p_ai, top_ai_model, top_ai_p). Human is the first label."""
    ai = F.slice(probs, 2, len(labels) - 1)
    return F.struct(F.get(probs, F.lit(0)).alias("p_human"), (1 - F.get(probs, F.lit(0))).alias("p_ai"), F.get(F.array(*map(F.lit, labels[1:])), argmax(ai)).alias("top_ai_model"), F.array_max(ai).alias("top_ai_p"))


def gates(probs: Column, votes_ai: Column, agree_top: Column, profile: str = "strict") -> Column:
    """struct(verdict, safe_for_action): inconclusive band, least P(AI), agreement, margin, in this order."""
    least, agree, gap, low, high = L.PROFILES[profile]
    p_human = F.get(probs, F.lit(0))
    passes = (votes_ai >= agree) & (margin(probs) >= gap)
    verdict = F.when(p_human.between(low, high), "INCONCLUSIVE").when(1 - p_human < least, "HUMAN").when(passes, "AI_DETECTED").otherwise("INCONCLUSIVE")
    safe = (verdict == "AI_DETECTED") & F.lit(profile == "strict") & (agree_top == 1.0) & (1 - p_human > 0.85)
    return F.struct(verdict.alias("verdict"), safe.alias("safe_for_action"))


def confidence_band(ratio: Column) -> Column:
    return F.when((ratio > 0.85) | (ratio < 0.10), "high").when((ratio > 0.70) | (ratio < 0.20), "moderate").otherwise("low")


def document_verdict(sentences: DataFrame, least: int = 3) -> DataFrame:
    """From doc_id, verdict, ai_model of sentences: counts, ratios (3 places), confidence and dominant model of each document."""
    is_ = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    by = sentences.groupBy("doc_id").agg(F.count("*").alias("n"), is_("AI_DETECTED").alias("ai"), is_("HUMAN").alias("human"), F.mode(F.when(F.col("verdict") == "AI_DETECTED", F.col("ai_model")), deterministic=True).alias("dominant"))
    enough, ratio = F.col("n") >= least, lambda c: F.round(F.col(c) / F.col("n"), 3)
    zero = lambda c: F.when(enough, F.col(c)).otherwise(0)
    other = F.col("n") - F.col("ai") - F.col("human")
    return by.select(
        "doc_id", F.col("n").alias("n_sentences"), zero("ai").alias("n_ai"), zero("human").alias("n_human"), F.when(enough, other).otherwise(0).alias("n_inconclusive"),
        F.when(enough, ratio("ai")).otherwise(0.0).alias("ai_ratio"), F.when(enough, ratio("human")).otherwise(1.0).alias("human_ratio"),
        F.when(enough, confidence_band(F.col("ai") / F.col("n"))).otherwise("insufficient_data").alias("confidence"), F.when(enough, F.col("dominant")).alias("dominant_ai_model"),
    )


def conformal(scores: DataFrame, alpha: float = 0.01, group: str | None = None, least: int = 100) -> DataFrame:
    """Thresholds from scores (p, y, and a group column): grp (null: all), n, tau_ai, tau_human, from human rows (y = 0).

    tau_ai is the k-th smallest score, k = ceil((n + 1)(1 - alpha)) held within 1..n; tau_human the median. Without a human row
    tau_ai is 1.01 and tau_human .49. Groups under `least` human rows have no row. The ranks are selected exactly, without sorting a group.
    """
    stage = Stage(scores.sparkSession, "conformal")
    human = scores.filter("y = 0 and p is not null").select((F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"), F.col("p").alias("v"))
    both = human.select(F.lit(None).cast("string").alias("g"), "v").unionByName(human.filter("g is not null")) if group else human
    n = F.col("n")
    need, low, high = F.least(n, F.greatest(F.lit(1), F.ceil((n + 1) * (1 - alpha) - 1e-9))), F.floor((n + 1) / 2), F.ceil((n + 1) / 2)
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("value")))
    found = selection.ranked(both, F.array(need, low, high), stage).groupBy(F.col("g").alias("grp"), "n").agg(at(need).alias("tau_ai"), ((at(low) + at(high)) / 2).alias("tau_human"))
    out = found.filter((n >= least) | F.col("grp").isNull()).select("grp", "n", "tau_ai", "tau_human")
    none = scores.sparkSession.createDataFrame([(None, 0, 1.01, 0.49)], "grp string, n bigint, tau_ai double, tau_human double")
    return out.unionByName(none.join(human.limit(1), F.lit(True), "left_anti"))


def conformal_decide(p: Column, tau_ai: Column, tau_human: Column) -> Column:
    return F.when(p >= tau_ai, "AI").when(p <= tau_human, "HUMAN").otherwise("INCONCLUSIVE")


def with_thresholds(scores: DataFrame, thresholds: DataFrame, group: str) -> DataFrame:
    """scores with tau_ai and tau_human of the row's group, or else of all. thresholds: one row a calibrated group."""
    own = thresholds.filter("grp is not null").select(F.col("grp").alias("g_"), F.col("tau_ai").alias("a_"), F.col("tau_human").alias("h_"))
    every = thresholds.filter("grp is null").select(F.col("tau_ai").alias("a0"), F.col("tau_human").alias("h0"))
    row = F.broadcast(every)  # a single row
    return scores.join(selection.small(own), F.col(group).cast("string") == F.col("g_"), "left").join(row, F.lit(True), "left").select(scores["*"], F.coalesce("a_", "a0").alias("tau_ai"), F.coalesce("h_", "h0").alias("tau_human"))


def fit_temperature(logits: DataFrame, labels: DataFrame, low: float = 0.05, high: float = 10.0, rounds: int = 40) -> float:
    """The temperature of least negative log likelihood, by golden-section search; each step is one aggregate over all rows.

    logits: doc_id, logits; labels: doc_id, label (index of the true class).
    """
    rows = logits.join(labels, "doc_id").select("logits", "label").persist()
    gold = (5**0.5 - 1) / 2

    def loss(points: list[float]) -> list[float]:
        each = [F.avg(-F.log(F.greatest(F.get(softmax(F.col("logits"), t), F.col("label")), F.lit(1e-12)))) for t in points]
        return [x if x is not None else 0.0 for x in rows.agg(*(c.alias(f"l{k}") for k, c in enumerate(each))).collect()[0]]

    a, b = low, high
    c, d = b - gold * (b - a), a + gold * (b - a)
    fc, fd = loss([c, d])
    for _ in range(rounds):
        if b - a < 1e-3:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - gold * (b - a)
            (fc,) = loss([c])
        else:
            a, c, fc = c, d, fd
            d = a + gold * (b - a)
            (fd,) = loss([d])
    rows.unpersist()
    return (a + b) / 2
