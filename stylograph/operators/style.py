"""Stylometric vectors and author profiles."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicons as L

SCALARS = (
    "vocabulary_richness avg_word_length rare_word_ratio hapax_legomena_ratio comma_rate semicolon_rate exclamation_rate question_rate ellipsis_rate dash_rate avg_sentence_length sentence_length_variance "
    "avg_paragraph_length avg_dep_distance max_dep_distance avg_tree_depth complex_sentence_ratio burstiness_score"
).split()
#: Features whose differences explain a comparison.
EXPLAINED = "vocabulary_richness avg_word_length rare_word_ratio hapax_legomena_ratio comma_rate semicolon_rate exclamation_rate question_rate avg_sentence_length sentence_length_variance avg_dep_distance avg_tree_depth complex_sentence_ratio burstiness_score".split()
RANKED = {"bigrams": 30, "trigrams": 20, "char4": 30, "char5": 20, "tag_bigrams": 15}
DIM = len(SCALARS) + len(L.FUNCTION_WORDS) + len(L.FILLERS) + len(L.TRANSITIONS) + sum(RANKED.values())
assert DIM == 216


MARK = "\0"  # between the words of a text that goes to a task's Python


def _numbered(items: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """Items as numbers from 0 in the order of their first use, and the number of each."""
    known = dict(zip(dict.fromkeys(items), itertools.count()))
    return np.fromiter(map(known.__getitem__, items), np.int64, len(items)), known


def _window_types(codes: np.ndarray, window: int) -> np.ndarray:
    """Types of each full window: a word counts in those that hold it but not its occurrence before."""
    order = np.argsort(codes, kind="stable")
    before, same = np.full(len(codes), -1), codes[order[1:]] == codes[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    at, n = np.arange(len(codes)), len(codes) - window + 1
    low, high = np.maximum(before + 1, at - window + 1), np.minimum(at, n - 1) + 1
    some = low < high
    return np.cumsum(np.bincount(low[some], minlength=n + 1) - np.bincount(high[some], minlength=n + 1))[:n]


def _moving_ratio(codes: np.ndarray, types: int, window: int = 100) -> float:
    n = len(codes)
    if n < window:
        return types / max(n, 1)
    found = _window_types(codes, window)[:: 1 if n < 2000 else 5 if n < 10000 else 10] / window
    return float(np.cumsum(found)[-1] / len(found))  # in order, as SQL adds


def mattr(words: Column, window: int = 100) -> Column:
    """Moving type-token ratio; the stride grows with the text."""

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> float | None:
            codes, known = _numbered(text.split(MARK) if text else [])
            return None if text is None else _moving_ratio(codes, len(known), window)

        return texts.map(one)

    return ratio(F.array_join(words, MARK))


def burstiness(lengths: Column) -> Column:
    """Of sentence lengths; 0 for under three."""
    return C.let(F.struct(C.mean(lengths).alias("m"), F.sqrt(C.variance(lengths)).alias("s")), lambda v: F.when((F.size(lengths) < 3) | (v["m"] + v["s"] < 1e-9), 0.0).otherwise((v["s"] - v["m"]) / (v["s"] + v["m"])))


def tags(text: Column) -> Column:
    """A tag for each word or mark, by the first rule that matches it whole."""
    tokens = C.matches(F.lower(text), r"(?U)\b\w+\b|[^\w\s]")

    def tag(t: Column) -> Column:
        out = F.lit("NOUN")
        for rule, name in reversed(L.TAGS):
            out = F.when(t.isin(*rule.split("|")) if rule.replace("|", "").isalpha() else t.rlike(f"(?U)^(?:{rule})$"), name).otherwise(out)
        return out

    return F.transform(tokens, tag)


def char_ngrams(text: Column, n: int) -> Column:
    """All character n-grams in order, from the text's characters as an array: a substring would be sought from the start each time."""
    of = lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*(F.get(c, i + k) for k in range(n))))).otherwise(F.array().cast(C.STRINGS))
    return C.let(F.filter(F.split(text, ""), lambda x: x != ""), of)


def _top(codes: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k largest counts of n-grams of codes (small numbers from 0) as shares of all of them, padded with 0. Ranked values don't depend on how
    ties are ordered."""
    out, many = np.zeros(k), len(codes) - n + 1
    if many > 0:
        codes = codes.astype(np.int64)
        keys, base = codes[:many], int(codes.max()) + 1
        top = base
        for i in range(1, n):
            if top > (1 << 62) // base:  # ranks of n-grams so far: their product with the codes' number stays in 64 bits
                keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
                top = int(keys.max()) + 1
            keys, top = keys * base + codes[i : many + i], top * base
        keys = np.sort(keys.astype(np.int32) if top < 1 << 31 else keys)
        found = np.sort(np.diff(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))))[::-1][:k]
        out[: len(found)] = found / many
    return out


#: TAGS for words, which hold word characters only: those listed, then those with an end after at least a character.
LISTED = {w: name for rule, name in reversed(L.TAGS) if rule.replace("|", "").isalpha() for w in rule.split("|")}
ENDS = [(tuple(rule[3:].strip("()").split("|")), name) for rule, name in L.TAGS if rule.startswith(r"\w+")]
ANY_END = tuple(e for ends, _ in ENDS for e in ends)


@functools.lru_cache(1 << 16)
def _tag(word: str) -> str:
    """What tags() gives a word; an empty one stands for a mark."""
    if not word:
        return "PUNCT"
    if word in LISTED:
        return LISTED[word]
    return next(name for ends, name in ENDS if word[1:].endswith(ends)) if word[1:].endswith(ANY_END) else "NUM" if word.isdecimal() else "NOUN"


TAG_CODES = {name: k for k, name in enumerate(sorted({"NOUN", *(name for _, name in L.TAGS)}))}
LEXICON = [*L.FUNCTION_WORDS, *L.FILLERS, *L.TRANSITIONS]
PLACES = {x: k for k, x in enumerate(LEXICON)}
#: What is counted for the rates of marks, in the order of measured().
MARKS = (",", ";", "!", "?", "...", "—", "–", " - ")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def measured(texts: pd.Series, lowered: pd.Series, words: pd.Series, tokens: pd.Series) -> pd.Series:
    """A text's words and their letters, its moving type-token ratio, the types used once or twice and once, how often it has each of MARKS, then
    what its vector has after SCALARS: each of LEXICON as a share of the words, and the shares of RANKED. words, tokens: the text's, joined by
    MARK; tokens are empty for marks."""

    def one(text: str, low: str, joined: str, tagged: str) -> np.ndarray:
        codes, known = _numbered(joined.split(MARK) if joined else [])
        many = len(codes)
        used = np.bincount(codes)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = (np.cumsum(np.bincount(points) > 0) - 1)[points]
        token, kinds = _numbered(tagged.split(MARK) if tagged else [])
        tag = np.array([TAG_CODES[_tag(x)] for x in kinds], np.int64)[token]
        items = {"bigrams": (codes, 2), "trigrams": (codes, 3), "char4": (chars, 4), "char5": (chars, 5), "tag_bigrams": (tag, 2)}
        ranked = {k: _top(*items[k], RANKED[k]) for k in RANKED}
        for k, short in (("bigrams", 1), ("trigrams", 2)):  # shares of words; character and tag n-grams are of their own number
            ranked[k] = ranked[k] * max(many - short, 0) / max(many, 1)
        hits = np.array([low.count(x) if " " in x else 0 for x in LEXICON], float)
        for x in known.keys() & PLACES.keys():
            hits[PLACES[x]] = used[known[x]]
        scalars = [many, len(joined) - max(many - 1, 0), _moving_ratio(codes, len(known)), (used < 3).sum(), (used < 2).sum(), *map(text.count, MARKS)]
        return np.concatenate([scalars, hits / max(many, 1), *ranked.values()])

    return pd.Series([one(*x) for x in zip(texts, lowered, words, tokens, strict=True)])


def stylometric(docs: DataFrame, text_col: str = "text", name: str = "style") -> DataFrame:
    """Adds <name>, a struct of SCALARS, and <name>_vector, array<double> of 216; zeros for texts under 20 characters."""
    f = docs.withColumn("t", F.coalesce(F.col(text_col), F.lit("")))
    f = f.withColumns({"low": F.lower("t"), "w": F.array_join(C.tok_word(F.col("t")), MARK), "tokens": F.array_join(C.matches(F.lower("t"), r"(?U)\b(\w+)\b|[^\w\s]", 1), MARK)})
    f = f.withColumns({"measured": measured("t", "low", "w", "tokens"), "sl": F.transform(C.sent_punct(F.col("t")), lambda s: F.size(C.tok_ws(s))), "pl": F.transform(C.paragraphs(F.col("t")), lambda s: F.size(C.tok_ws(s)))})
    f = f.withColumns({"d": F.greatest(F.size("sl"), F.lit(1)), "enough": F.col("t").rlike(r"(?Us)\S.{18,}?\S")})
    d, enough = F.col("d"), F.col("enough")
    at = lambda k: F.get("measured", F.lit(k))
    n = F.greatest(at(0), F.lit(1.0))
    rate = lambda *pieces: sum((at(5 + MARKS.index(p)) for p in pieces), F.lit(0.0)) / d
    scalars = {
        "vocabulary_richness": at(2), "avg_word_length": at(1) / n, "rare_word_ratio": at(3) / n, "hapax_legomena_ratio": at(4) / n,
        "comma_rate": rate(","), "semicolon_rate": rate(";"), "exclamation_rate": rate("!"), "question_rate": rate("?"), "ellipsis_rate": rate("..."), "dash_rate": rate("—", "–", " - "),
        "avg_sentence_length": C.mean(F.col("sl")), "sentence_length_variance": C.variance(F.col("sl")), "avg_paragraph_length": C.mean(F.col("pl")),
        **{k: F.lit(0.0) for k in ("avg_dep_distance", "max_dep_distance", "avg_tree_depth", "complex_sentence_ratio")}, "burstiness_score": burstiness(F.col("sl")),
    }
    f = f.withColumn(name, F.struct(*(F.when(enough, v).otherwise(0.0).cast("double").alias(k) for k, v in scalars.items())))
    vector = F.concat(F.array(*(F.col(name)[k] for k in SCALARS)), F.slice("measured", 6 + len(MARKS), DIM - len(SCALARS)))
    return f.select(*(f[c] for c in docs.columns), name, F.when(enough, vector).otherwise(F.array_repeat(F.lit(0.0), DIM)).alias(f"{name}_vector"))


def signature_words(docs: DataFrame, author: str, text_col: str = "text", k: int = 20) -> DataFrame:
    """author, rank, word, n: words of over 3 letters, used 3 times or more, not in a short stop list; ties by word."""
    from pyspark.sql import Window

    words = docs.select(F.col(author).alias("author"), F.explode(C.tok_word(F.coalesce(F.col(text_col), F.lit("")))).alias("word")).filter((F.length("word") > 3) & ~F.col("word").isin(*L.COMMON_ENGLISH))
    counts = words.groupBy("author", "word").agg(F.count("*").alias("n")).filter("n >= 3")
    # first the best k of each slice of the words, then of those: no task ranks all words of an author
    cut = counts.withColumn("cell", F.pmod(F.xxhash64("word"), F.lit(64)))
    order = (F.desc("n"), F.asc("word"))
    some = cut.withColumn("r", F.row_number().over(Window.partitionBy("author", "cell").orderBy(*order))).filter(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("author").orderBy(*order))).filter(F.col("rank") <= k).select("author", F.col("rank").cast("long").alias("rank"), "word", "n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity held within 0 and 1; 0 if a vector is 0."""
    dot = lambda x, y: C.total(F.zip_with(x, y, lambda u, v: u * v))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(0.0)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda v: (v["x"] - v["m"]) / F.when(v["s"] < 1e-9, 1.0).otherwise(v["s"]))


def fuse(stat: Column, embedding: Column, weight: float = 0.6) -> Column:
    """The two vectors, each to length 1, weighted and joined."""
    unit = lambda v, w: C.let(F.sqrt(C.total(F.transform(v, lambda x: x * x))) + 1e-9, lambda n: F.transform(v, lambda x: x / n * w))
    return F.when(F.coalesce(F.size(embedding), F.lit(0)) <= 0, stat).otherwise(F.concat(unit(stat, weight), unit(embedding, 1 - weight)))


def centroids(vectors: DataFrame, author: str, vector: str, dim: int = DIM) -> DataFrame:
    """author, n, mean and std (population) of each dimension, as arrays. Sums by dimension are made before the shuffle."""
    x = lambda k: F.get(F.col(vector), F.lit(k))
    return vectors.groupBy(F.col(author).alias("author")).agg(F.count("*").alias("n"), F.array(*(F.avg(x(k)) for k in range(dim))).alias("mean"), F.array(*(F.stddev_pop(x(k)) for k in range(dim))).alias("std"))


def thresholds(vectors: DataFrame, author: str, vector: str, dim: int = DIM) -> DataFrame:
    """author, n, threshold: mean less deviation of each sample's similarity to the mean of the others (sum less itself), from 3 samples on."""
    c = centroids(vectors, author, vector, dim)
    std = F.transform("std", lambda s: s + 1e-9)
    rows = vectors.select(F.col(author).alias("a_"), F.col(vector).alias("x")).join(F.broadcast(c) if dim <= 1024 and c.count() <= 10_000 else c, F.col("a_").eqNullSafe(F.col("author"))).filter("n >= 3")
    others = F.zip_with("mean", "x", lambda m, x: (m * F.col("n") - x) / (F.col("n") - 1))
    sims = rows.select("author", "n", cosine(zscore(others, F.col("mean"), std), zscore(F.col("x"), F.col("mean"), std)).alias("sim"))
    return sims.groupBy("author", "n").agg(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.avg("sim") - F.stddev_pop("sim"))).alias("threshold"))


def compare(profile: Column, candidate: Column, similarity: Column, threshold: Column) -> Column:
    """struct(distances map, anomalous array, same_author, confidence) of two structs of SCALARS."""
    diffs = F.map_from_arrays(F.array(*map(F.lit, EXPLAINED)), F.array(*(F.abs(profile[k] - candidate[k]) / (F.abs(profile[k]) + 1e-9) for k in EXPLAINED)))
    odd = C.let(diffs, lambda m: F.filter(F.map_keys(m), lambda k: m[k] > 0.30))
    return C.let(odd, lambda o: F.struct(diffs.alias("distances"), o.alias("anomalous"), (similarity >= threshold).alias("same_author"), F.least(F.lit(1.0), similarity + 0.1 * (1 - F.size(o) / len(EXPLAINED))).alias("confidence")))


def quick_compare(candidates: DataFrame, texts: list[str], text_col: str = "text", embed: Callable[[Column], Column] | None = None, scorer: Callable[[Column, Column], Column] | None = None, threshold: float = 0.80) -> DataFrame:
    """Adds similarity, threshold and comparison (see compare) of each candidate with one author, whose samples are `texts`.

    The profile is that of the samples as one text, each dimension relative to the samples' mean and deviation; candidates are measured
    likewise. From three samples on the threshold is the samples' own. embed gives a text's vector, which is fused with the others; scorer
    gives the similarity of two vectors in place of the cosine.
    """
    if not texts:
        raise ValueError("no sample")
    spark = candidates.sparkSession
    samples = stylometric(spark.createDataFrame([("a", x) for x in texts], "author string, text string"))
    known = centroids(samples, "author", "style_vector").select("mean", "std").collect()[0]
    least = thresholds(samples, "author", "style_vector").collect()
    own = stylometric(spark.createDataFrame([(" ".join(texts),)], "text string"))
    numbers = lambda x: F.array(*map(F.lit, x))
    relative = lambda v: zscore(v, numbers(known["mean"]), numbers(known["std"]))
    full = lambda v, t: relative(v) if embed is None else fuse(relative(v), embed(t))
    author = own.select("style", full(F.col("style_vector"), F.col("text")).alias("v")).collect()[0]
    profile = F.struct(*(F.lit(author["style"][k]).alias(k) for k in SCALARS))
    measured = stylometric(candidates, text_col, "q_style")
    pair = numbers(author["v"]), full(F.col("q_style_vector"), F.col(text_col))
    score = cosine(*pair) if scorer is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), scorer(*pair)))
    out = measured.withColumns({"similarity": score, "threshold": F.lit(float(least[0]["threshold"]) if least else threshold)})
    return out.withColumn("comparison", compare(profile, F.col("q_style"), F.col("similarity"), F.col("threshold"))).drop("q_style", "q_style_vector")


def word_windows(text: Column, size: int, stride: int, least: int = 1, tail: bool = True) -> Column:
    """array<struct<offset, text>> of word windows; those after the last full one are not made."""
    return C.let(C.tok_ws(text), lambda w: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - size), F.lit(stride)), lambda i: F.struct(i.alias("offset"), F.slice(w, i + 1, size).alias("words"))), lambda x: F.size(x["words"]) >= least))


def transition(flags: Column) -> Column:
    """Index of the first flagged window after a clean one; null if there is none."""
    clean = F.array_position(flags, F.lit(False))
    at = F.filter(F.transform(flags, lambda f, i: F.when(f & (i >= clean), i)), lambda i: i.isNotNull())
    return F.when(clean > 0, F.array_min(at))


def smooth(p: Column) -> Column:
    """Kernel .25, .5, .25 with zeros outside, from three values on."""
    return F.when(F.size(p) < 3, p).otherwise(F.transform(p, lambda x, i: 0.25 * F.coalesce(F.when(i > 0, F.get(p, i - 1)), F.lit(0.0)) + 0.5 * x + 0.25 * F.coalesce(F.get(p, i + 1), F.lit(0.0))))
