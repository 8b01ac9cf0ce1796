"""Feature vectors of a text, one struct of doubles each. Every profiler is a projection: no shuffle, whole texts only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L

STYLE_V7 = "word_count avg_word_len type_token_ratio hapax_ratio sent_len_mean sent_len_var burstiness bigram_repeat trigram_repeat punct_entropy stopword_ratio uppercase_ratio".split()
REASONING = [*"type_token_ratio mean_sentence_length std_sentence_length mean_word_length punctuation_ratio stopword_ratio".split(), *L.MARKERS, "paragraph_length_cv", "word_entropy_normalised"]
HALLUCINATION = (
    "hedging_ratio overconfidence_ratio negation_ratio entity_density unique_entity_ratio person_org_ratio date_num_ratio unigram_entropy bigram_entropy avg_jaccard_similarity min_jaccard_similarity max_semantic_drop "
    "disconnected_sentences_ratio vague_quantifier_ratio specificity_score assertive_hedged_ratio self_referential_ratio entity_repetition_rate phrase_repetition_rate factual_density sentence_length_uniformity "
    "modal_verb_ratio superlative_ratio numeric_precision_ratio temporal_specificity"
).split()
LEXICONS = (L.HEDGING, L.ABSOLUTE, L.NEGATION, L.VAGUE, L.MODAL, L.SUPERLATIVE)
PERPLEXITY = (
    "proxy_perplexity_mean proxy_perplexity_std perplexity_curve_slope low_perplexity_ratio perplexity_valley_count perplexity_range token_entropy_mean token_entropy_std burstiness_perplexity curvature_score smoothing_factor hybrid_segment_ratio"
).split()
assert (len(STYLE_V7), len(REASONING), len(HALLUCINATION), len(PERPLEXITY)) == (12, 15, 25, 12)


def _with(docs: DataFrame, text_col: str, **columns: Column) -> DataFrame:
    """docs and helper columns, each set in a projection of its own so that later ones read it instead of repeating it."""
    out = docs.withColumn("t", F.coalesce(F.col(text_col), F.lit("")))
    for name, column in columns.items():
        out = out.withColumn(name, column)
    return out


def _finish(frame: DataFrame, docs: DataFrame, features: dict[str, Column], enough: Column, name: str, otherwise: float = 0.0) -> DataFrame:
    struct = F.struct(*(F.when(enough, v).otherwise(otherwise).cast("double").alias(k) for k, v in features.items()))
    return frame.select(*(frame[c] for c in docs.columns), struct.alias(name))


def style_v7(docs: DataFrame, text_col: str = "text", name: str = "style_v7") -> DataFrame:
    """Adds a struct of STYLE_V7; all 0 without a Latin word."""
    f = _with(docs, text_col, w=C.tok_latin(F.lower("t")))
    f = f.withColumns({"n": F.size("w"), "grams": C.gram_stats(F.col("w"), (1, 2, 3)), "sl0": F.transform(C.sent_punct(F.col("t")), lambda s: F.size(C.tok_latin(s))), "p": C.run_counts(C.matches(F.col("t"), "[,.;:!?\\-—\"'()]"))})
    f = f.withColumn("sl", F.when(F.size("sl0") > 0, F.col("sl0")).otherwise(F.array("n")))
    f = f.withColumns({"mu": C.mean(F.col("sl")), "va": C.variance(F.col("sl"))})
    sd = F.sqrt("va")
    repeat = lambda k: F.when(F.col("n") >= k, 1 - F.get("grams", F.lit(3 * k - 3)) / (F.col("n") - k + 1)).otherwise(0.0)
    features = {
        "word_count": F.col("n"),
        "avg_word_len": F.length(F.array_join("w", "")) / F.col("n"),
        "type_token_ratio": F.get("grams", F.lit(0)) / F.col("n"),
        "hapax_ratio": F.get("grams", F.lit(1)) / F.col("n"),
        "sent_len_mean": F.col("mu"),
        "sent_len_var": F.col("va"),
        "burstiness": F.when(sd + F.col("mu") > 0, (sd - F.col("mu")) / (sd + F.col("mu"))).otherwise(0.0),
        "bigram_repeat": repeat(2),
        "trigram_repeat": repeat(3),
        "punct_entropy": C.entropy(F.col("p")),
        "stopword_ratio": C.share_in(F.col("w"), L.STYLE_STOP) / F.col("n"),
        "uppercase_ratio": F.regexp_count("t", F.lit(r"\p{Lu}")) / F.greatest(F.lit(1), F.length("t")),
    }
    return _finish(f, docs, features, F.col("n") > 0, name)


def reasoning(docs: DataFrame, text_col: str = "text", name: str = "reasoning") -> DataFrame:
    """Adds a struct of REASONING; all 0 under 20 words."""
    f = _with(docs, text_col, low=F.lower("t"))
    f = f.withColumns({
        "w": C.tok_ws(F.col("low")),
        "sl": F.filter(F.transform(C.sent_capital(F.col("t")), lambda s: F.size(C.tok_ws(s))), lambda n: n >= 3),
        "pl": F.transform(C.paragraphs(F.col("t")), lambda s: F.size(C.tok_ws(s))),
    })
    f = f.withColumns({"n": F.size("w"), "s": F.greatest(F.size("sl"), F.lit(1)), "grams": C.gram_stats(F.col("w"), offset=1e-9)})
    v, spread = F.get("grams", F.lit(0)), F.get("grams", F.lit(2))
    features = {
        "type_token_ratio": v / F.col("n"),
        "mean_sentence_length": C.mean(F.col("sl")),
        "std_sentence_length": F.sqrt(C.variance(F.col("sl"), 1)),
        "mean_word_length": F.length(F.array_join("w", "")) / F.col("n"),
        "punctuation_ratio": F.regexp_count("t", F.lit(r"(?U)[^\w\s]")) / F.greatest(F.length(C.trimmed(F.col("t"))), F.lit(1)),
        "stopword_ratio": C.share_in(F.col("w"), L.REASONING_STOP) / F.col("n"),
        **{k: F.regexp_count("low", F.lit("(?U)" + p)) / F.col("s") for k, p in L.MARKERS.items()},
        "paragraph_length_cv": F.when(F.size("pl") >= 2, F.sqrt(C.variance(F.col("pl"), 1)) / F.greatest(C.mean(F.col("pl")), F.lit(1e-9))).otherwise(0.0),
        "word_entropy_normalised": F.when(v >= 2, spread / F.log2(v)).otherwise(0.0),
    }
    return _finish(f, docs, features, F.col("n") >= 20, name)


def _phrase(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a text as whole words; texts without it need no pattern."""
    return F.when(F.contains(text, F.lit(phrase)), F.regexp_count(text, F.lit(rf"(?U)\b{phrase}\b"))).otherwise(0)


def hallucination(docs: DataFrame, text_col: str = "text", name: str = "hallucination") -> DataFrame:
    """Adds a struct of HALLUCINATION, without entity features (0, as where no parser is at hand); all 0 under 20 characters."""
    f = _with(docs, text_col, low=F.lower("t"))
    f = f.withColumns({"w": C.tok_word(F.col("t")), "st": F.filter(F.transform(F.split("low", "(?U)" + L.GUARDED_STOP), C.tok_word), lambda s: F.size(s) > 0)})
    # a set of both sentences' words, from which follows what they share
    f = f.withColumns({"grams": C.gram_stats(F.col("w"), (1, 2, 4)), "hits": C.among(F.col("w"), *LEXICONS), "sets": F.transform("st", F.array_distinct)})
    jaccard = F.transform(
        F.when(F.size("st") >= 2, F.sequence(F.lit(0), F.size("st") - 2)),
        lambda i: C.let(F.size(F.array_union(F.get("sets", i), F.get("sets", i + 1))), lambda u: (F.size(F.get("sets", i)) + F.size(F.get("sets", i + 1)) - u) / u),
    )
    f = f.withColumns({
        "n": F.greatest(F.size("w"), F.lit(1)), "sims": jaccard, "sl": F.transform("st", lambda s: F.size(s)), "numbers": C.matches(F.col("t"), "(?U)" + L.NUMBER), "enough": F.length(C.trimmed(F.col("t"))) >= 20,
        "hedge": C.share_in(F.col("hits"), L.HEDGING), "absolute": C.share_in(F.col("hits"), L.ABSOLUTE), "specific": F.regexp_count("low", F.lit("(?U)" + L.SPECIFIC_DATE)), "vague": F.regexp_count("low", F.lit("(?U)" + L.VAGUE_TIME)),
    })
    n, sims, hedge, absolute, specific, vague = (F.col(c) for c in ("n", "sims", "hedge", "absolute", "specific", "vague"))
    many = F.size("st") >= 2
    drops = F.when(F.size("sims") >= 2, F.transform(F.sequence(F.lit(1), F.size("sims") - 1), lambda i: F.get(sims, i - 1) - F.get(sims, i)))
    ratio = lambda words: C.share_in(F.col("hits"), words) / n
    precise = F.filter("numbers", lambda x: x.contains(".") | (F.length(F.replace(x, F.lit("."), F.lit(""))) >= 4))
    zero = F.lit(0.0)
    features = {
        "hedging_ratio": hedge / n,
        "overconfidence_ratio": absolute / n,
        "negation_ratio": ratio(L.NEGATION),
        "entity_density": zero,
        "unique_entity_ratio": zero,
        "person_org_ratio": zero,
        "date_num_ratio": zero,
        "unigram_entropy": F.get("grams", F.lit(2)),
        "bigram_entropy": F.get("grams", F.lit(5)),
        "avg_jaccard_similarity": F.when(many, C.mean(sims)).otherwise(1.0),
        "min_jaccard_similarity": F.when(many, F.array_min(sims)).otherwise(1.0),
        "max_semantic_drop": F.coalesce(F.when(many, F.array_max(drops)), zero),
        "disconnected_sentences_ratio": F.when(many, F.size(F.filter(sims, lambda x: x == 0)) / F.size(sims)).otherwise(0.0),
        "vague_quantifier_ratio": ratio(L.VAGUE),
        "specificity_score": zero,
        "assertive_hedged_ratio": absolute / F.greatest(absolute + hedge, F.lit(1)),
        "self_referential_ratio": sum((_phrase(F.col("low"), p) for p in L.SELF_REFERENCE), F.lit(0)) / F.greatest(F.size("st"), F.lit(1)),
        "entity_repetition_rate": zero,
        "phrase_repetition_rate": F.when(F.size("w") >= 4, (F.get("grams", F.lit(6)) - F.get("grams", F.lit(7))) / (F.size("w") - 3)).otherwise(0.0),
        "factual_density": zero,
        "sentence_length_uniformity": F.when(many, 1 - F.least(F.sqrt(C.variance(F.col("sl"))) / F.greatest(C.mean(F.col("sl")), F.lit(1.0)), F.lit(1.0))).otherwise(0.5),
        "modal_verb_ratio": ratio(L.MODAL),
        "superlative_ratio": ratio(L.SUPERLATIVE),
        "numeric_precision_ratio": F.size(precise) / F.greatest(F.size("numbers"), F.lit(1)),
        "temporal_specificity": F.when(specific + vague > 0, specific / (specific + vague)).otherwise(0.5),
    }
    return _finish(f, docs, features, F.col("enough"), name)


# perplexity without a language model
def proxy_perplexity(tokens: Column, orders: tuple[int, ...] = (2, 3, 4)) -> Column:
    """From a text's own n-grams, on a scale of 1 (repetitive) to 15; 10 for under 3 tokens."""
    n = F.size(tokens)

    def signal(k: int) -> Column:
        def of(c: Column) -> Column:
            types, all_ = F.size(c), n - k + 1
            return 0.35 * F.size(F.filter(c, lambda x: x == 1)) / types + 0.35 * types / all_ + 0.30 * (1 - F.aggregate(F.filter(c, lambda x: x > 1), F.lit(0), lambda a, x: a + x) / all_)

        return F.when(n >= k + 2, C.let(C.run_counts(C.ngrams(tokens, k)), of))

    scores = F.filter(F.array(*(signal(k) for k in orders)), lambda s: s.isNotNull())
    return F.when(n < 3, 10.0).otherwise(C.let(scores, lambda s: F.when(F.size(s) == 0, 10.0).otherwise(F.least(F.lit(15.0), F.greatest(F.lit(1.0), 1 + 14 * C.mean(s) + 1 / n)))))


def window_perplexities(windows: Column, orders: tuple[int, ...] = (2, 3, 4)) -> Column:
    """proxy_perplexity of each window, a string of words with a space between, in a task's Python."""

    def one(w: list[str]) -> float:
        n, total, many = len(w), 0.0, 0
        for k in orders:
            if n >= k + 2:
                c, all_ = C.counts_of(w, k), n - k + 1
                once = c.count(1)
                total += 0.35 * once / len(c) + 0.35 * len(c) / all_ + 0.30 * (1 - (all_ - once) / all_)  # as Spark adds: sum() compensates
                many += 1
        return 10.0 if n < 3 or not many else min(15.0, max(1.0, 1 + 14 * (total / many) + 1 / n))

    @F.pandas_udf(C.NUMBERS)
    def each(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else [one(x.split(" ") if x else []) for x in row])

    return each(windows)


def sentence_windows(text: Column, size: int = 7, step: int = 5, least: int = 64) -> Column:
    """Windows of sentences, those of `least` words or more; the whole text if none is left or it has under 3 sentences."""

    def windows(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(step)), lambda i: F.array_join(F.slice(s, i + 1, size), " "))
        whole = F.array(F.array_join(s, " "))
        return F.when(F.size(s) < 3, whole).otherwise(C.let(F.filter(cut, lambda x: F.size(C.tok_ws(x)) >= least), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(whole)))

    return C.let(F.transform(C.sent_capital(text), C.trimmed), windows)


def token_windows(tokens: Column, size: int = 50, step: int = 25) -> Column:
    """Entropy of each window of tokens, which hold no space; of all if there are no more than a window has. In a task's Python."""

    @F.pandas_udf(C.NUMBERS)
    def each(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float] | None:
            w = text.split(" ") if text else []
            return None if text is None else [C.bits(C.counts_of(w[i : i + size])) for i in range(0, max(len(w) - size, 0) + 1, step)]

        return texts.map(one)

    return each(F.array_join(tokens, " "))


def valleys(values: Column, threshold: float) -> Column:
    """Contiguous runs below the threshold."""
    below = F.transform(values, lambda v: v < threshold)
    return C.let(below, lambda b: F.size(F.filter(F.transform(b, lambda x, i: x & ((i == 0) | ~F.coalesce(F.get(b, i - 1), F.lit(False)))), lambda x: x)))


def slope(values: Column) -> Column:
    """Least squares over the index; 0 for one value."""
    n = F.size(values)
    centre = (n - 1) / 2
    top = C.total(F.transform(values, lambda v, i: (i - centre) * v))
    return F.when(n > 1, top / (n * (n * n - 1.0) / 12)).otherwise(0.0)


def perplexity(docs: DataFrame, text_col: str = "text", name: str = "perplexity", low: float = 7.0) -> DataFrame:
    """Adds a struct of PERPLEXITY and the arrays <name>_windows; all 0 (none) under 15 words."""
    f = _with(docs, text_col, w=C.tok_word(F.col("t")), win=sentence_windows(F.col("t")))
    f = f.withColumns({"ppl": window_perplexities(F.transform("win", lambda x: F.array_join(C.tok_word(x), " "))), "ent": token_windows(F.col("w")), "enough": F.size(C.tok_ws(F.col("t"))) >= 15})
    f = f.withColumns({"mu": C.mean(F.col("ppl")), "sd": F.sqrt(C.variance(F.col("ppl")))})
    share = F.size(F.filter("ppl", lambda p: p < low)) / F.size("ppl")
    features = {
        "proxy_perplexity_mean": F.col("mu"),
        "proxy_perplexity_std": F.col("sd"),
        "perplexity_curve_slope": slope(F.col("ppl")),
        "low_perplexity_ratio": share,
        "perplexity_valley_count": valleys(F.col("ppl"), low),
        "perplexity_range": F.array_max("ppl") - F.array_min("ppl"),
        "token_entropy_mean": C.mean(F.col("ent")),
        "token_entropy_std": F.sqrt(C.variance(F.col("ent"))),
        "burstiness_perplexity": F.when(F.col("mu") > 0, F.col("sd") / F.col("mu")).otherwise(0.0),
        "curvature_score": F.lit(0.0),
        "smoothing_factor": F.when(F.size("w") > 0, 1 / F.size("w")).otherwise(0.0),
        "hybrid_segment_ratio": share,
    }
    out = _finish(f.withColumn(f"{name}_windows", F.when(F.col("enough"), F.col("ppl"))), docs.withColumn(f"{name}_windows", F.lit(None)), features, F.col("enough"), name)
    return out
