"""What reports show: levels of style metrics, explanations of sentences, merged statistics, indicator words, distances of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from . import report


def style_levels(values: dict[str, Column]) -> Column:
    """array<struct<metric, value, level>> of the metrics of L.STYLE_LEVELS that are given and not null, in that order."""

    def one(name: str) -> Column:
        low, high = L.STYLE_LEVELS[name]
        v = values[name].cast("double")
        return F.when(v.isNotNull(), F.struct(F.lit(name).alias("metric"), v.alias("value"), F.when(v >= high, "HIGH").when(v >= low, "MEDIUM").otherwise("LOW").alias("level")))

    return F.array_compact(F.array(*(one(k) for k in L.STYLE_LEVELS if k in values)))


def explain_sentence(score: Column, indicators: Column) -> Column:
    """A sentence's explanation: by the level of its score, with its first three indicators."""
    text = F.lit(L.SENTENCE_TEXTS[-1][1])
    for least, words in reversed(L.SENTENCE_TEXTS[:-1]):
        text = F.when(score >= least, words).otherwise(text)
    return F.concat(text, F.when(F.size(indicators) > 0, F.format_string(L.INDICATORS_TEXT, F.array_join(F.slice(indicators, 1, 3), "; "))).otherwise(L.NO_INDICATORS_TEXT))


def merged_stats(profile: dict[str, Column], detected: dict[str, Column], given: dict[str, Column]) -> Column:
    """struct of L.DEFAULT_STATS: what is given, else what was detected and isn't 0, else the profile's, else the default."""
    none = F.lit(None).cast("double")
    pick = lambda k, default: F.coalesce(given.get(k, none), F.nullif(detected.get(k, none), F.lit(0.0)), profile.get(k, none), F.lit(default))
    return F.struct(*(pick(k, v).alias(k) for k, v in L.DEFAULT_STATS.items()))


def syntactic_distance(profile: list[Column], candidate: list[Column]) -> Column:
    """Mean of the differences of features, each relative to the profile's."""
    return sum((F.abs(a - b) / (F.abs(a) + 1e-9) for a, b in zip(profile, candidate, strict=True)), F.lit(0.0)) / len(profile)


def indicators(docs: DataFrame) -> DataFrame:
    """doc_id, kind, n, weight of the indicator words of a text; a word of both lists counts as ai. The table is a fixed list."""
    rows = [(w, "ai", s) for w, s in report.AI_WORDS.items()] + [(w, "human", s) for w, s in report.HUMAN_WORDS.items() if w not in report.AI_WORDS]
    table = docs.sparkSession.createDataFrame(rows, "word string, kind string, strength double")
    words = docs.select("doc_id", F.explode(C.tok_ws(F.lower("text"))).alias("raw")).select("doc_id", F.regexp_replace("raw", r"(?U)[^\w]", "").alias("word"))
    return words.join(F.broadcast(table), "word").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum("strength").alias("weight"))


def counter(items: Column) -> Column:
    """struct(types, most): how many different items there are, and how often the most frequent one occurs. Exact at every size."""
    return C.let(C.run_counts(items), lambda c: F.struct(F.size(c).cast("long").alias("types"), F.coalesce(F.array_max(c), F.lit(0)).cast("long").alias("most")))
