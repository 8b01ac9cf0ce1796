"""Risk levels from feature structs: weighted sums and severity votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def hallucination_categories(f: Column) -> dict[str, Column]:
    """The eight category means of a HALLUCINATION struct."""
    avg = lambda *x: sum(x[1:], x[0]) / len(x)
    entropy = lambda k: F.least(f[k] / 10.0, F.lit(1.0))
    return {
        "lexical_risk": avg(f["hedging_ratio"], f["overconfidence_ratio"], f["negation_ratio"]),
        "entity_anomaly": avg(f["entity_density"], 1 - f["unique_entity_ratio"], f["entity_repetition_rate"]),
        "entropy": avg(entropy("unigram_entropy"), entropy("bigram_entropy")),
        "semantic_incoherence": avg(1 - f["avg_jaccard_similarity"], f["max_semantic_drop"], f["disconnected_sentences_ratio"]),
        "vagueness": avg(f["vague_quantifier_ratio"], 1 - f["specificity_score"], 1 - f["assertive_hedged_ratio"]),
        "repetition": avg(f["self_referential_ratio"], f["entity_repetition_rate"], f["phrase_repetition_rate"]),
        "structural_anomaly": avg(f["sentence_length_uniformity"], f["modal_verb_ratio"], f["superlative_ratio"]),
        "imprecision": avg(1 - f["numeric_precision_ratio"], 1 - f["temporal_specificity"]),
    }


def hallucination_risk(f: Column) -> Column:
    """struct(score, level). Levels change at .25 and .5, before rounding."""
    parts = hallucination_categories(f)
    score = clip(sum((parts[k] * w for k, w in L.RISK_WEIGHTS.items()), F.lit(0.0)))
    return C.let(score, lambda s: F.struct(F.round(s, 4).alias("score"), F.when(s < 0.25, "LOW").when(s < 0.5, "MEDIUM").otherwise("HIGH").alias("level")))


def _norm(f: Column, name: str) -> Column:
    return F.least(F.lit(1.0), f[name] / max(L.REASONING_THRESHOLDS[name][1], 1e-9))


def reasoning_risk(f: Column) -> Column:
    """struct(score, level) of a REASONING struct."""
    score = sum((w * _norm(f, k) for k, w in L.REASONING_WEIGHTS.items()), F.lit(0.0)) + 0.08 * F.greatest(F.lit(0.0), 1 - _norm(f, "intuition_leap_density"))
    return C.let(F.round(clip(score), 4), lambda s: F.struct(s.alias("score"), F.when(s >= 0.55, "HIGH").when(s >= 0.28, "MEDIUM").otherwise("LOW").alias("level")))


def reasoning_groups(f: Column) -> Column:
    n = lambda k: _norm(f, k)
    return F.struct(
        (n("backtracking_density") * 0.55 + n("cot_scaffold_density") * 0.45).alias("self_correction"),
        (n("consequence_density") * 0.30 + n("causal_density") * 0.25 + n("contrast_density") * 0.20 + n("sequence_density") * 0.25).alias("connectors"),
        (n("type_token_ratio") * 0.5 + n("word_entropy_normalised") * 0.5).alias("richness"),
        n("paragraph_length_cv").alias("structure"),
        F.greatest(F.lit(0.0), 1 - n("intuition_leap_density")).alias("no_intuition"),
    )


def reasoning_service_score(f: Column) -> Column:
    """The other score of a REASONING struct."""
    return clip(0.4 * f["cot_scaffold_density"] * 10 + 0.4 * f["backtracking_density"] * 10 - 0.2 * f["intuition_leap_density"] * 10)


def level(value: Column, name: str) -> Column:
    """high, medium or low of a REASONING feature."""
    low, high = L.REASONING_THRESHOLDS[name]
    return F.when(value >= high, "high").when(value >= low, "medium").otherwise("low")


def _vote(value: Column, high: Column, medium: Column) -> Column:
    return F.when(high, 1.0).when(medium, 0.5).otherwise(0.0)


def perplexity_risk(f: Column, tokens: Column) -> Column:
    """Mean vote of the severity levels, drawn to .5 under 300 tokens; 0 under 15. Curvature has no vote where it is 0."""
    v = lambda k, test, high, medium: _vote(f[k], test(f[k], high), test(f[k], medium))
    under, over = (lambda x, t: x < t), (lambda x, t: x > t)
    votes = [
        v("proxy_perplexity_mean", under, 4.0, 7.0), v("token_entropy_mean", under, 3.0, 4.5), v("burstiness_perplexity", under, 0.05, 0.15),
        v("low_perplexity_ratio", over, 0.7, 0.3), v("perplexity_valley_count", lambda x, t: x >= t, 3, 1),
    ]
    curvature = F.when(f["curvature_score"] != 0, v("curvature_score", over, 3.0, 1.5))
    raw = C.mean(F.filter(F.array(*votes, curvature), lambda x: x.isNotNull()))
    drawn = F.when(tokens < 300, 0.5 + (raw - 0.5) * tokens / 300.0).otherwise(raw)
    return F.when(tokens < 15, 0.0).otherwise(F.round(clip(drawn), 4))


def reference_risk(total: Column, mean_confidence: Column, fabricated: Column, chimeric: Column, ornamental: Column) -> Column:
    """Mean vote of four citation features; 0 without a reference."""
    votes = [_vote(mean_confidence, mean_confidence < 40, mean_confidence < 70), *(_vote(x, x > 0.3, x > 0.1) for x in (fabricated, chimeric)), _vote(ornamental, ornamental > 0.5, ornamental > 0.2)]
    return F.when(total < 1, 0.0).otherwise(F.round(clip(sum(votes[1:], votes[0]) / 4), 4))


def top_values(f: Column, names: list[str], k: int = 3) -> Column:
    """array<struct<feature, value>> of the k largest features; ties in the order of names."""
    items = F.array(*(F.struct((-f[n]).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("feature")) for i, n in enumerate(names)))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct(x["feature"].alias("feature"), (-x["v"]).alias("value")))


def top_signals(f: Column, k: int = 5) -> Column:
    """array<struct<feature, value>>: the k weighted REASONING features of largest normalised value."""
    names = [*L.REASONING_WEIGHTS, "intuition_leap_density"]
    return top_values(F.struct(*(_norm(f, n).alias(n) for n in names)), names, k)


def category_levels(f: Column) -> Column:
    """Map of risk category to high, medium or low for display: from .6 and .3."""
    return F.create_map(*(x for k, v in hallucination_categories(f).items() for x in (F.lit(k), F.when(v >= 0.6, "high").when(v >= 0.3, "medium").otherwise("low"))))


def baseline(ppl: Column, burstiness: Column, diversity: Column, length: Column, grade: Column) -> Column:
    """array<struct<metric, value, human, deviates>>: values beside what people write; over 30 % off deviates."""
    pairs = {"perplexity": (ppl, 55.0), "burstiness": (burstiness, 0.25), "lexical_diversity": (diversity, 0.70), "sentence_length": (length, 16.0), "grade": (grade, 10.0)}
    return F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), F.lit(h).alias("human"), (F.abs(v - h) / h > 0.30).alias("deviates")) for k, (v, h) in pairs.items()))
