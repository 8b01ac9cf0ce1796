"""Column building blocks: tokenizers, sentence splitters, counts, n-grams, normalisation. All run inside the JVM."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

STRINGS, NUMBERS = "array<string>", "array<double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once a row: the optimizer can't inline it into body's lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_letter(text: Column) -> Column:
    """For lower-casing letter by letter, as SQL does: else İ becomes two characters and a last Σ another letter than elsewhere."""
    return F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ"))


# tokenizers: not interchangeable
def tok_word(text: Column) -> Column:
    return matches(F.lower(text), r"[\p{L}\p{N}_]+")


def tok_ws(text: Column) -> Column:
    return matches(text, r"(?U)\S+")


def tok_latin(text: Column) -> Column:
    return matches(text, r"[A-Za-z']+")


def nonblank(parts: Column) -> Column:
    return F.filter(parts, lambda s: s.rlike(r"(?U)\S"))


def sent_punct(text: Column) -> Column:
    return nonblank(F.split(text, r"[.!?]+"))


def sent_capital(text: Column) -> Column:
    return nonblank(F.split(trimmed(text), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\"'])"))


def sent_guarded(text: Column) -> Column:
    """For lower-cased text."""
    return nonblank(F.split(text, "(?U)" + L.GUARDED_STOP))


def paragraphs(text: Column) -> Column:
    return nonblank(F.split(text, "\n\n"))


def run_counts(items: Column) -> Column:
    """How often each different item occurs, in the items' order: n log n, no shuffle."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1) == x), -1).otherwise(i)), lambda i: i >= 0)
        return let(starts, lambda b: F.transform(b, lambda i, k: F.coalesce(F.get(b, k + 1), F.size(s)) - i))

    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, counted(s)).otherwise(F.array().cast("array<int>")))


def counts_of(words: list[str], n: int = 1) -> list[int]:
    """How often each different n-gram occurs; for a task's Python."""
    return list(Counter(zip(*(words[i:] for i in range(n)), strict=False) if n > 1 else words).values())


def bits(counts: list[int], offset: float = 0.0) -> float:
    n = sum(counts)
    return 0.0 - sum(c / n * math.log2(c / n + offset) for c in counts)


def gram_stats(words: Column, orders: tuple[int, ...] = (1,), offset: float = 0.0) -> Column:
    """For each order the types of a text's n-grams, how many of them occur once, and their entropy in bits, one after another, as doubles.
    Words hold no space. offset: what logarithms add to a share. It is evaluated in Python, so no lambda can hold it."""

    @F.pandas_udf(NUMBERS)
    def stats(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float] | None:
            w, out = text.split(" ") if text else [], []
            for n in orders:
                c = counts_of(w, n)
                out += [float(len(c)), float(c.count(1)), bits(c, offset)]
            return None if text is None else out

        return texts.map(one)

    return stats(F.array_join(words, " "))


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 if empty."""
    bits = lambda c: let(F.aggregate(c, F.lit(0), lambda a, x: a + x), lambda n: F.aggregate(c, F.lit(0.0), lambda a, x: a - (x / n) * F.log2(x / n)))
    return let(counts, bits)


def ngrams(words: Column, n: int) -> Column:
    """Space-joined n-grams in order; empty if there are fewer words."""
    of = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))).otherwise(F.array().cast(STRINGS))
    return let(words, of)


def mean(numbers: Column) -> Column:
    return let(numbers, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)).otherwise(0.0))


def variance(numbers: Column, ddof: int = 0) -> Column:
    """Population (ddof 0) or sample (ddof 1) variance; 0 for too few numbers."""
    squares = lambda a: let(mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return let(numbers, lambda a: F.when(F.size(a) > ddof, squares(a) / (F.size(a) - ddof)).otherwise(0.0))


def share_in(words: Column, lexicon: list[str]) -> Column:
    """How many of the words are in the lexicon."""
    return F.size(F.filter(words, lambda w: w.isin(*lexicon)))


def among(words: Column, *lexicons: list[str]) -> Column:
    """The words that are in any of the lexicons: a short array, in which share_in looks for each."""
    return F.filter(words, lambda w: w.isin(*sorted({x for lexicon in lexicons for x in lexicon})))


def occurrences(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


# normalisation
def clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s{2,}", " "), r"(?U)\s+([,.;:?!])", "$1")


def join_hyphens(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2"), r"(?U)\s*\n\s*", " "))


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, L.ZERO_WIDTH, "")


def fold_confusables(text: Column) -> Column:
    return F.translate(text, L.CONFUSABLE_FROM, L.CONFUSABLE_TO)


def confusables(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, L.CONFUSABLE_FROM, ""))


def canonical(text: Column, nfkc: Callable[[Column], Column] = lambda t: t) -> Column:
    """Zero width, NFKC (given as a function; identity for Latin-1 text), confusables, hyphens, spaces, in this order."""
    folded = fold_confusables(nfkc(strip_zero_width(text)))
    return trimmed(F.regexp_replace(F.regexp_replace(join_hyphens(folded), r"(?U)\s{2,}", " "), r"(?U)\s+([,.;:?!])", "$1"))


def tamper(text: Column) -> Column:
    """struct(replaced, removed, ratio, suspicious). Replaced letters count twice in the ratio's denominator, as specified."""
    bare = strip_zero_width(text)
    replaced, removed = confusables(bare), F.length(text) - F.length(bare)
    latin = F.length(F.regexp_replace(fold_confusables(bare), "[^A-Za-z]", ""))
    ratio = F.when(latin + replaced > 0, replaced / (latin + replaced)).otherwise(0.0)
    return F.struct(replaced.alias("replaced"), removed.alias("removed"), ratio.alias("ratio"), ((ratio >= 0.02) | (removed > 0)).alias("suspicious"))


def family(label: Column, families: list[tuple[str, str]], default: str | None = None) -> Column:
    """The family whose key comes first in the list among those that the label contains."""
    out = F.lit(default)
    for key, name in reversed(families):
        out = F.when(F.lower(label).contains(key), name).otherwise(out)
    return out
