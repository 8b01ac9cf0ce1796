"""Tests for statistical watermarks of language models, over given token ids and entropies."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANTS, GAMMA, CONTEXT, LEAST = 10, 0.5, 1, 20


def context_hash(tokens: list[int], variant: int) -> int:
    return int(hashlib.sha256(f"{variant}:{':'.join(map(str, tokens))}".encode()).hexdigest()[:8], 16)


@lru_cache(maxsize=4096)
def green(seed: int, vocabulary: int, gamma: float) -> np.ndarray:
    """The green part of the vocabulary, one bit a token."""
    mask = np.zeros(vocabulary, bool)
    mask[np.random.default_rng(seed % 2**31).choice(np.arange(vocabulary), int(vocabulary * gamma), replace=False)] = True
    return mask


#: Bits of green lists that are held at a time.
HELD = 1 << 26


def _hits(ids: np.ndarray, first: np.ndarray, vocabulary: int, gamma: float, width: int, variants: int) -> np.ndarray:
    """Green tokens of each text under each variant. ids: the texts' tokens, one after another; first: where each begins, and the end.

    Each context that occurs is hashed once a variant, however often it occurs; a token counts if its context lies in its own text.
    """
    at = np.arange(len(ids))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = at[at - first[text] >= width]
    seen, which = np.unique(np.stack([ids[at - width + k] for k in range(width)], 1), axis=0, return_inverse=True)
    order = np.argsort(which, kind="stable")  # tokens by context, so that green lists are made in lots
    at, which = at[order], which.ravel()[order]
    known = (ids[at] >= 0) & (ids[at] < vocabulary)
    token, of = np.where(known, ids[at], 0), text[at]
    out, lot = np.zeros((len(first) - 1, variants), np.int64), max(1, HELD // vocabulary)
    for a in range(0, len(seen), lot):
        low, high = np.searchsorted(which, [a, a + lot])
        contexts = seen[a : a + lot].tolist()
        for v in range(variants):
            lists = np.stack([green(context_hash(c, v), vocabulary, gamma) for c in contexts])
            hit = lists[which[low:high] - a, token[low:high]] & known[low:high]
            out[:, v] += np.bincount(of[low:high][hit], minlength=len(out))
    return out


def green_zs(texts: list, vocabulary: int = 1000, gamma: float = GAMMA, width: int = CONTEXT, variants: int = VARIANTS) -> list[dict]:
    """For each text its best z over the hash variants (0 at least), its corrected p and green share; 0, 1, .5 for too few tokens."""
    rows = [np.asarray([int(i) for i in x] if x is not None else [], np.int64) for x in texts]
    enough = [x if len(x) >= max(LEAST, width + 10) else x[:0] for x in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in enough])]).astype(np.int64)
    hits = _hits(np.concatenate([*enough, np.zeros(0, np.int64)]), first, vocabulary, gamma, width, variants)
    out = []
    for x, found in zip(enough, hits.tolist(), strict=True):
        best, share, n = 0.0, 0.5, len(x) - width
        for h in found if len(x) else ():
            z = (h / n - gamma) / math.sqrt(gamma * (1 - gamma) / n)
            if z > best:
                best, share = z, h / n
        out.append({"z": best, "p": min(1.0, 0.5 * math.erfc(best / math.sqrt(2)) * variants) if len(x) else 1.0, "green": share})
    return out


def green_z(ids: list[int] | None, **kw) -> dict:
    """green_zs of one text."""
    return green_zs([ids], **kw)[0]


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("z", "p", "green")]))
def green_test(ids: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(green_zs(list(ids)), columns=["z", "p", "green"])


def periodicity(values: np.ndarray | None) -> float:
    """The largest inner peak of the autocorrelation; 0 for up to 20 values or constant ones."""
    x = np.asarray(values if values is not None else [], float)
    if len(x) <= 20:
        return 0.0
    f = np.fft.rfft(x - x.mean(), n=2 * len(x))
    r = np.fft.irfft(f * np.conj(f))[: len(x)]
    if abs(r[0]) < 1e-12:
        return 0.0
    r = np.round(r / r[0], 9)  # equal neighbours stay equal, whatever the order of their sums
    peaks = r[1:-1][(r[1:-1] > r[:-2]) & (r[1:-1] > r[2:])]
    return float(peaks.max()) if len(peaks) else 0.0


@F.pandas_udf(T.DoubleType())
def entropy_periodicity(values: pd.Series) -> pd.Series:
    return values.map(periodicity)


def rule(z: Column, p: Column, green_share: Column, period: Column) -> Column:
    """struct(detected, scheme, confidence): detected if p < .05 and z > 2."""
    found = (p < 0.05) & (z > 2)
    scheme = F.when(~found, "none").when(green_share > 0.55, "green_red").when(period > 0.25, "periodic").otherwise("unknown")
    return F.struct(found.alias("detected"), scheme.alias("scheme"), F.when(found, F.least(F.lit(1.0), -F.log10(F.greatest(p, F.lit(1e-10))) / 5)).otherwise(0.0).alias("confidence"))
