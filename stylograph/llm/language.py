"""Language ID by multilingual mixture inference.

Each language has a smoothed model of letter n-grams, which gives every word a likelihood. A document is a mixture: its words are
drawn from languages in proportions that expectation-maximisation estimates. The set of languages is that of highest
penalised likelihood (half the log of the number of words for every language more, times a factor): starting from all, the one of least
proportion is dropped as long as that raises it. The prediction is the language of largest proportion in the set.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import draw_limit, texts

#: Bounds of the sample the models are fitted on: documents of each language, and n-grams, of which every language has an equal share.
SAMPLE, GRAMS = 2000, 200_000
#: Values of lang that are learned at most.
LANGUAGES = 1000
ORDER = 3
PENALTY, ROUNDS = 6.0, 25
#: Rounds of EM that look whether it can still matter.
CHECKED = frozenset((0, 1, 2, 4, 7, 11, 16))
WORD = re.compile(r"[^\W\d_]+")
CACHE = 200_000
UNKNOWN = "und"


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(1, ORDER + 1) for i in range(len(w) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
            own = total.setdefault(lang, Counter())
            for w, n in Counter(WORD.findall(text.lower())).items():
                for g in grams(w):
                    own[g] += n
    rows = [(k, g, n) for k, c in total.items() for g, n in c.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: n-gram to its row, and log likelihoods by language: of known n-grams, then of unknown ones of each length.
    rows: dict[str, int]
    table: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE, grams_kept: int = GRAMS, languages: int = LANGUAGES) -> Model:
    """docs: doc_id, text, lang; rows with a null in text or lang teach nothing, repeated rows count again. Keep held-out ones out of it.

    A language is known by the n-grams that rank among its most frequent GRAMS / languages, ties counted in, so that no language takes the
    room of another. The model has a column a language and a row an n-gram of any; an empty table gives a model without languages.
    Of more than `languages` values of lang, those of the most documents are learned (ties by name): the rest are mistakes in a column rather than languages.
    """
    known = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Model([], {}, np.zeros((ORDER, 0)))
    # a row a language
    limits = F.broadcast(docs.sparkSession.createDataFrame([(k, draw_limit(sample, n)) for k, n in sizes.items()], "l_lang string, l_most bigint"))
    drawn = known.select("doc_id", "lang", "text").join(limits, F.col("lang") == F.col("l_lang")).filter(F.xxhash64("doc_id", "text", F.lit("sample")) <= F.col("l_most")).select("lang", "text")
    counts = drawn.mapInArrow(_counts, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    upto = F.count("*").over(Window.partitionBy("lang").orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).filter(F.col("upto") <= max(1, grams_kept // len(sizes))).collect()
    langs = sorted(sizes)
    column = {k: i for i, k in enumerate(langs)}
    rows = {g: i for i, g in enumerate(sorted({r["gram"] for r in found}))}
    n = np.zeros((len(rows), len(langs)))
    for r in found:
        n[rows[r["gram"]], column[r["lang"]]] += r["n"]
    order = np.array([len(g) for g in rows], np.int64)
    table = np.zeros((len(rows) + ORDER, len(langs)))
    for k in range(1, ORDER + 1):
        own = order == k
        total = n[own].sum(0) + 0.5 * (own.sum() + 1)
        table[: len(rows)][own] = np.log((n[own] + 0.5) / total)
        table[len(rows) + k - 1] = np.log(0.5 / total)
    weight = np.append(order, np.arange(1, ORDER + 1))[:, None] / (ORDER * (ORDER + 1) / 2)
    return Model(langs, rows, (table * weight).astype(np.float32))


def proportions(likelihood: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, enough: float = -np.inf) -> tuple[np.ndarray, float]:
    """EM: proportions of the columns and the log likelihood. likelihood: log, a row a word; counts: of the words.

    It ends early once no proportions at all can reach a log likelihood over `enough`: that of any is at most the present one's plus, for
    each word, the largest derivative by a column less one, as the log likelihood is concave.
    """
    top = likelihood.max(1)
    p, base, n = np.exp(likelihood - top[:, None]), float(counts @ top), counts.sum()
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for k in range(rounds):
        mix = p @ pi
        slope = (counts / mix) @ p / n
        if k in CHECKED and (value := base + float(counts @ np.log(mix))) + n * (float(slope.max()) - 1) <= enough:
            return pi, value
        new = pi * slope
        done = np.abs(new - pi).max() < 1e-4
        pi = new
        if done:
            break
    return pi, base + float(counts @ np.log(np.maximum(p @ pi, 1e-300)))


def mixture(likelihood: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> dict[int, float]:
    """The chosen columns and their proportions."""
    cost = penalty * np.log(max(2.0, counts.sum())) / 2
    single = counts @ likelihood
    best = (float(single.max()) - cost, {int(single.argmax()): 1.0})
    if float(counts @ likelihood.max(1)) - 2 * cost <= best[0]:  # not even the likeliest language of every word would pay for a second one
        return best[1]
    chosen = list(range(likelihood.shape[1]))
    while len(chosen) > 1:
        pi, value = proportions(likelihood[:, chosen], counts, enough=best[0] + 2 * cost)
        if value - 2 * cost <= best[0]:  # no set of two or more within this one does better
            break
        if value - len(chosen) * cost > best[0]:
            best = (value - len(chosen) * cost, dict(zip(chosen, pi.tolist(), strict=True)))
        chosen.pop(int(pi.argmin()))
    return best[1]


def _packed(points: np.ndarray, n: int) -> np.ndarray:
    """The n code points from every place on, in one number."""
    out = points[: len(points) - n + 1].copy()
    for k in range(1, n):
        out = out << 21 | points[k : len(points) - n + 1 + k]
    return out


class Scorer:
    """Log likelihoods of words by language: the sums over their n-grams, which are looked up in sorted arrays, all words of a call at once."""

    def __init__(self, model: Model):
        self.unknown, self.width = len(model.rows), len(model.langs)
        self.table = np.vstack([model.table, np.zeros((1, self.width), np.float32)])  # the last row: no n-gram
        self.known = []
        for n in range(1, ORDER + 1):
            own = [(sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g)), row) for g, row in model.rows.items() if len(g) == n]
            own.sort()
            self.known.append((np.array([k for k, _ in own] or [-1], np.int64), np.array([r for _, r in own] or [self.unknown], np.int64)))

    def __call__(self, words: list[str]) -> np.ndarray:
        points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(w) + 2 for w in words])
        start = np.cumsum(length) - length
        left = np.repeat(start + length, length) - np.arange(len(points))  # characters from here to the word's end
        out = np.zeros((len(words), self.width), np.float32)
        for n, (keys, rows) in enumerate(self.known, 1):
            grams = _packed(points, n)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            row = np.full(len(points), len(self.table) - 1)
            row[: len(grams)] = np.where(left[: len(grams)] >= n, np.where(keys[at] == grams, rows[at], self.unknown + n - 1), len(self.table) - 1)
            out += np.add.reduceat(self.table[row], start, 0)
        return out


def _predicted(model: Model, penalty: float, with_mixture: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = max(2, min(CACHE, (1 << 24) // max(1, len(model.langs))))
        block = max(1, min(4096, room // 64))  # words that are scored at once
        place: dict[str, int] = {}
        held = np.zeros((room, len(model.langs)), np.float32)
        score = Scorer(model)

        def learn(words: list[str]) -> None:
            for i in range(0, len(words), block):
                some = words[i : i + block]
                held[len(place) : len(place) + len(some)] = score(some)
                place.update(zip(some, range(len(place), len(place) + len(some)), strict=True))

        for batch in batches:
            out = []
            for text in texts(batch.column("text")):
                words = Counter(WORD.findall(text.lower()))
                if not words or not model.langs:
                    out.append((UNKNOWN, 0.0, []))
                    continue
                parts = list(words.items())
                like = []
                for i in range(0, len(parts), room // 2):  # a text with more words than are held
                    some = parts[i : i + room // 2]
                    if len(place) + len(some) > room:
                        place.clear()
                    learn([w for w, _ in some if w not in place])
                    like.append(held[[place[w] for w, _ in some]])
                found = mixture(np.concatenate(like).astype(np.float64), np.fromiter((c for _, c in parts), np.float64, len(parts)), penalty)
                top = max(found, key=lambda k: (found[k], -k))
                out.append((model.langs[top], min(1.0, found[top]), sorted(((model.langs[k], min(1.0, v)) for k, v in found.items()), key=lambda x: (-x[1], x[0]))))
            columns = [batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if with_mixture:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                columns.append(pa.array([[{"lang": a, "share": b} for a, b in x[2]] for x in out], kind))
                names.append("mixture")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), mixture (languages and proportions, largest first) of every row.

    docs: doc_id bigint, text; other columns are left out, whatever their names. A text that is null or has no letter, or a model without
    languages, gives `und`, 0 and an empty mixture. Repeated rows each get a row, an empty table none; of languages of equal proportion the
    first by name counts. Texts are taken whole, however long.
    """
    return docs.select("doc_id", "text").mapInArrow(_predicted(model, penalty, True), "doc_id bigint, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
