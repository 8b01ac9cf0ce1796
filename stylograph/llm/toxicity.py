"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings is trained in numpy from confirmed toxic documents and
unlabelled text alone. The risk of a classifier g is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): what unlabelled text loses as
negative, less the share that the positives in it account for, and never below zero; where a step would make that part
negative, it is taken back instead. The prior is the share of toxic documents among the labelled ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, share, texts

#: Bounds of the sample the classifier is fitted on, in documents, and of its features.
POSITIVE, UNLABELLED, FEATURES = 3000, 6000, 5000
BEGINNINGS = (4, 5, 6)
#: Standard errors by which a feature must be more frequent in confirmed text: chance gives that to none of millions.
CLEAR = 5.5
WORD = re.compile(r"\w+")
CACHE = 500_000


#: A word or beginning counts as one, two or three features: found in one, two, three or more different words of the text.
LEVELS = 3


def stems(word: str) -> tuple[int, ...]:
    """Hashes of a word and its beginnings, with room for the level."""
    names = [f"w {word}", *(f"b {word[:k]}" for k in BEGINNINGS if len(word) >= k)]
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 3 << 2 for x in names)


def features(found: Iterable[int]) -> list[int]:
    """From the stems of a text's different words, repeats included."""
    return sorted(f + k for f, n in Counter(found).items() for k in range(min(n, LEVELS)))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(f for w in set(WORD.findall(x.lower())) for f in stems(w)) for x in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.int64()))], names=["positive", "found"])


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of feature indices, by Adam on the non-negative risk with the logistic loss."""

    def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(rows) if rows else np.zeros(0, np.int64)).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (cp, rp), (cu, ru) = packed(positive), packed(unlabelled)
    w, b = np.zeros(n), -2.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp = b + np.bincount(rp, w[cp], len(positive))
        zu = b + np.bincount(ru, w[cu], len(unlabelled))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # derivatives of the risk by each row's value
        dp, du = prior * -sigmoid(-zp) / len(positive), sigmoid(zu) / len(unlabelled)
        dn = -prior * sigmoid(zp) / len(positive)
        dp, du = (dp + dn, du) if negative >= -beta else (-dn, -du)
        g = np.append(np.bincount(cp, dp[rp], n) + np.bincount(cu, du[ru], n) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:n], b - step[n]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED, scratch: Scratch | None = None) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows of labels teach; keep held-out ones out of it.

    At most about `positive` confirmed and `unlabelled` other documents are read, drawn by hashes of doc_id (and text). Without a toxic label
    the model gives every text the prior, here 0, and likewise where labels or docs are empty. Repeated rows count again; a null text is empty.
    """
    counts = labels.filter("toxic is not null").agg(F.count("*").alias("n"), F.sum("toxic").alias("p"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("d")).collect()[0]
    if not counts["p"]:
        return Model({}, -40.0)
    prior = counts["p"] / counts["n"]
    chosen = labels.filter((F.col("toxic") == 1) & share(positive, counts["d"], "doc_id")).select(F.col("doc_id").alias("p_id")).distinct()
    confirmed = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["p_id"]).select(F.lit(True).alias("positive"), "text")  # at most about `positive` ids
    others = docs.filter(share(unlabelled, docs.count(), "doc_id", "text")).select(F.lit(False).alias("positive"), "text")
    scratch = scratch or Scratch(docs.sparkSession, "toxicity")
    drawn = scratch.table(confirmed.union(others).mapInArrow(_sample, "positive boolean, found array<bigint>"), "sample")
    size = drawn.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).collect()[0]
    if not size["p"] or not size["u"]:
        return Model({}, -40.0 if not size["p"] else 0.0)
    known = [r["feature"] for r in telling(drawn, size["p"], size["u"]).collect()]
    rows = drawn.mapInArrow(_placed({f: k for k, f in enumerate(known)}), "positive boolean, found array<bigint>").toArrow()
    scratch.drop("sample")
    by, is_positive = rows.column("found").to_pylist(), rows.column("positive").to_pylist()
    some = lambda kind: [np.array(x, np.int64) for x, y in zip(by, is_positive, strict=True) if y == kind]
    w, b = nnpu(some(True), some(False), len(known), prior)
    return Model({f: float(x) for f, x in zip(known, w, strict=True)}, b)


def telling(drawn: DataFrame, n_p: int, n_u: int) -> DataFrame:
    """feature, z: the FEATURES ones whose share differs most between confirmed and other rows, in standard errors; ties by feature.

    drawn: positive, found. Counts are made before the shuffle; the driver gets the chosen features alone.
    """
    counts = drawn.select("positive", F.explode("found").alias("feature")).groupBy("feature").agg(F.count_if("positive").alias("up"), F.count_if(~F.col("positive")).alias("total"))
    pooled = (F.col("up") + F.col("total")) / (n_p + n_u)
    z = (F.col("up") / n_p - F.col("total") / n_u) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    return counts.filter("up + total >= 3").select("feature", z.alias("z")).filter(F.col("z") > CLEAR).orderBy(F.desc("z"), "feature").limit(FEATURES)


def _placed(place: dict[int, int]):
    """The rows with the places of the features that have one, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(k for f in row if (k := place.get(f)) is not None) for row in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.int64()))], names=["positive", "found"])

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cache = model.weights, {}
        known = {f & ~3 for f in weights}
        for batch in batches:
            out = []
            for text in texts(batch.column("text")):
                found: list[int] = []
                if len(cache) > CACHE:
                    cache.clear()
                for w in set(WORD.findall(text.lower())):
                    hit = cache.get(w)
                    if hit is None:
                        hit = cache[w] = tuple(f for f in stems(w) if f in known)
                    if hit:
                        found.extend(hit)
                z = model.bias + sum(weights.get(f, 0.0) for f in features(found))
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row (0 to 1). docs: doc_id bigint, text; a null text counts as empty.

    Other columns are left out, whatever their names. Repeated rows each get a row, an empty table none. Texts are taken whole.
    """
    return docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id bigint, score double")
