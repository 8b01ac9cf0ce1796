"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A window of `length` tokens gives queue s a quantum of length * share(s), the
target proportions being given, or else the queues' shares of all tokens, and serves the queues in turn; what a queue was owed and
could not be served in whole tokens is its deficit, carried into the next window. A queue that has run out is passed over, and the
others keep their proportions among themselves. In closed form: at time t queue s has served min(N_s, floor(rate_s t + 1/2))
tokens, so its deficit stays within one token until it runs out; a window's end is the t at which the queues together have
served a multiple of `length`, ties going to queues in order. So any partition knows the deficits it inherits from the windows
before it, whoever packs them, and no token moves: documents are tokenized where they lie, and only counts of tokens by
partition and queue are added up. Every window but the last is full.

A source whose quantum would be under LEAST tokens cannot be held to a proportion within a window, and its documents would be
torn into single tokens. All such sources share one queue, in the order of their documents, so there are at most length / LEAST
queues, however many sources there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts

LENGTH, END = 2048, 1
#: Tokens a window that a source needs for a queue of its own, by its bytes.
LEAST = 2
STEPS = 50
#: Tokens of a document that are placed at a time.
SEGMENT = 1 << 16
#: Runs of white space this long are split off before the pattern, whose backtracking fails on a million characters.
LONG = 100_000
#: What \s is in the pattern (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def encoder(path: str):
    """Text to ids as the tokenizers library gives them for a byte-level BPE file, by a faster library for the same merges."""
    import json
    import re

    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    assert spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["normalizer"] is None
    # the printable stand-ins of the byte-level alphabet
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    #: Fixed value: the splitting pattern of this family of tokenizers.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    made = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    plain_ids = lambda text: made.encode_to_numpy(text, allowed_special="all")
    space = re.compile(f"[{SPACE}]+")

    def encode(text: str) -> np.ndarray:
        if len(text) < LONG:
            return plain_ids(text)
        parts, at = [], 0
        for m in space.finditer(text):
            if m.end() - m.start() >= LONG:
                # \s+(?!\S): the run as one piece, but for its last character if another follows
                stop = m.end() - (m.end() < len(text))
                parts += [plain_ids(text[at : m.start()]), np.array(made._encode_single_piece(text[m.start() : stop]), np.uint32)]
                at = stop
        return np.concatenate([*parts, plain_ids(text[at:])]) if parts else plain_ids(text)

    return encode


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, served = encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            out, size = [], 0

            def made(rows: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "queue", "part", "before", "doc_tokens", "ids"])

            for doc, queue, text in zip(batch.column("doc_id").to_pylist(), batch.column("queue").to_pylist(), texts(batch.column("text")), strict=True):
                ids = np.append(encode(text), END).astype("<u4")
                small = ids.astype("<u2") if ids.max() < 65536 else ids
                out.append((doc, queue, part, served.get(queue, 0), len(ids), small.tobytes()))
                served[queue] = served.get(queue, 0) + len(ids)
                size += small.nbytes
                if size > 16 << 20:
                    yield made(out)
                    out, size = [], 0
            yield made(out)

    return run


class Mixture:
    """Where windows end in each queue. totals: tokens of each queue, in order; weights: their target proportions, by default the totals."""

    def __init__(self, totals: list[int], length: int, weights: list[float] | None = None):
        self.totals, self.length, self.n = np.array(totals, np.int64), length, int(sum(totals))
        self.own = weights is None
        if self.own:
            self.rates = self.totals.astype(np.float64)
        else:
            w = np.array(weights, np.float64)
            there = self.totals > 0
            self.rates = np.where(there, w * (self.totals[there] / w[there]).max(initial=0.0), 0.0)

    def served(self, t: np.ndarray) -> np.ndarray:
        """Tokens of each queue served at time t, from 0 to 1: rows by t. Monotone in t also in floating point."""
        return np.minimum(np.floor(self.rates[None, :] * t[:, None] + 0.5).astype(np.int64), self.totals[None, :])

    def ends(self, k: np.ndarray) -> np.ndarray:
        """Tokens of each queue in the first k windows: rows by k."""
        step_t = 1 << STEPS
        want = np.minimum(k * self.length, self.n)
        low, high = np.zeros(len(k), np.int64), np.full(len(k), step_t, np.int64)
        if self.own and self.n:  # all queues run to the end: at t they have served n t, within half a token each
            room = len(self.totals) + 2
            low = np.clip(((want - room) / self.n * step_t).astype(np.int64), 0, step_t - 1)
            high = np.clip(((want + room) / self.n * step_t).astype(np.int64) + 1, low + 1, step_t)
        while (high - low > 1).any():  # the last step at which no more than want is served
            mid = (low + high) // 2
            fits = self.served(mid / step_t).sum(1) <= want
            low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        base, step = self.served(low / step_t), self.served(high / step_t)
        before = np.cumsum(step - base, 1) - (step - base)
        out = base + np.clip((want - base.sum(1))[:, None] - before, 0, step - base)
        out[want == self.n] = self.totals
        return out

    def windows(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The window of each token, given by its queue and its number there: from the time at which it is served."""
        last = max(0, -(-self.n // self.length) - 1)
        t = np.minimum((token + 0.5) / self.rates[queue], 1.0)
        k = np.clip((self.served(t).sum(1) - 1) // self.length, 0, last)
        open_ = np.arange(len(k))
        while len(open_):  # rounding and ties may put it into a window beside
            both, at = np.unique(np.concatenate([k[open_], k[open_] + 1]), return_inverse=True)
            ends = self.ends(both)
            early = token[open_] < ends[at[: len(open_)], queue[open_]]
            late = token[open_] >= ends[at[len(open_) :], queue[open_]]
            k[open_] += late.astype(np.int64) - early
            open_ = open_[early | late]
        return k

    def touched(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The windows that hold a token of each stretch: at most one a token, whatever the corpus."""
        first, last = self.windows(queue, start), self.windows(queue, start + size - 1)
        return [np.arange(a, b + 1) if b - a < n else np.unique(self.windows(np.full(n, q), s + np.arange(n))) for q, s, n, a, b in zip(queue.tolist(), start.tolist(), size.tolist(), first.tolist(), last.tolist(), strict=True)]


def _pieces(totals: list[int], weights: list[float] | None, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mixture(totals, length, weights)
        for batch in batches:
            held, n = [], 0
            for doc, queue, start, size, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "start", "doc_tokens", "ids")), strict=True):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * size else "<u4")
                for at in range(0, size, SEGMENT):
                    held.append((doc, queue, start + at, at, size, ids[at : at + SEGMENT].astype("<u4")))
                    n += len(held[-1][-1])
                    if len(held) >= 256 or n >= 4 * SEGMENT:
                        yield made(held, mix)
                        held, n = [], 0
            if held:
                yield made(held, mix)

    def made(rows: list, mix: Mixture) -> pa.RecordBatch:
        queues, starts, sizes = (np.array(x, np.int64) for x in zip(*((r[1], r[2], len(r[5])) for r in rows), strict=True))
        touched = mix.touched(queues, starts, sizes)
        all_ = np.concatenate(touched)
        ks = np.unique(np.concatenate([all_, all_ + 1]))
        ends = mix.ends(ks)
        out: list[tuple] = []
        for (doc, queue, start, at, size, ids), own in zip(rows, touched, strict=True):
            here = np.searchsorted(ks, own)
            low, high = ends[here], ends[here + 1]
            before = (high[:, :queue] - low[:, :queue]).sum(1) - low[:, queue]
            a, b = np.maximum(low[:, queue], start), np.minimum(high[:, queue], start + len(ids))
            for k, i, j, offset in zip(own.tolist(), a.tolist(), b.tolist(), (before + a).tolist(), strict=True):
                if j > i:
                    piece = ids[i - start : j - start]
                    out.append((doc, at + i - start, j - i, zlib.crc32(piece), size, k, offset, *([piece.tolist()] if with_ids else [])))
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(kinds)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    return run


def shared_out(sizes: dict[str | None, int], rest: int, length: int, targets: dict[str | None, float] | None = None) -> tuple[list[list[str | None]], list[float] | None]:
    """The sources of each queue, the shared one first as [], and the queues' weights (None: by tokens).

    sizes: bytes of the sources that may have a queue of their own; rest: bytes of all others. A source that targets doesn't name
    weighs what its share of the bytes is.
    """
    total = rest + sum(sizes.values())
    weight = {k: (targets or {}).get(k, n / total if total else 0.0) for k, n in sizes.items()}
    if any(w <= 0 for k, w in weight.items() if k in (targets or {})):
        raise ValueError("target proportions are to be positive")
    rest_weight = rest / total if total else 0.0
    whole = rest_weight + sum(weight.values())
    own = sorted(sizes, key=lambda k: (weight[k], k is not None, k or ""))
    while own and weight[own[0]] * length < LEAST * whole:
        rest_weight += weight[own.pop(0)]
    own.sort(key=lambda k: (k is not None, k or ""))
    weights = [rest_weight, *(weight[k] for k in own)]
    return [[], *([k] for k in own)], weights if targets else None


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, length: int = LENGTH, with_ids: bool = False, targets: dict[str | None, float] | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    docs: doc_id bigint, text, and source if there is one; other columns are not read, whatever their names. tokenizer: the path of
    a byte-level BPE file that every executor has. targets: target proportions of sources, in any unit in which all sum to about
    1; what it doesn't name has its share of the bytes, and without it the proportions are those of all tokens. A null text
    counts as empty and is its end id alone; a null source is a source. Repeated rows are documents of their own. An empty table
    gives no row. Texts of any length are encoded whole and placed in segments. Sequences have gapless offsets from 0 and `length`
    tokens, the last one what is left.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<bigint>" * with_ids
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", F.col("text"), source.alias("source"))
    sizes = base.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"))
    sizes = scratch.table(sizes, "sizes")
    total = sizes.agg(F.sum("n")).collect()[0][0]
    if not total:
        return docs.sparkSession.createDataFrame([], schema)
    # at most length / LEAST sources are that large, and targets is the caller's
    large = F.col("n") * length >= LEAST * total
    if targets:
        large = large | F.col("source").isin([k for k in targets if k is not None]) | (F.col("source").isNull() if None in targets else F.lit(False))
    some = {r["source"]: r["n"] for r in sizes.filter(large).collect()}
    queues, weights = shared_out(some, total - sum(some.values()), length, targets)
    known = {x: k for k, own in enumerate(queues) for x in own}
    pairs = [F.lit(v) for kv in known.items() if kv[0] is not None for v in kv]
    queue = F.when(F.col("source").isNull(), F.lit(known.get(None, 0))).otherwise(F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0)) if pairs else F.lit(0)).cast("int")
    done = scratch.table(base.select("doc_id", queue.alias("queue"), "text").mapInArrow(_tokens(tokenizer), "doc_id bigint, queue int, part int, before bigint, doc_tokens bigint, ids binary"), "tokens")
    by_part = scratch.table(done.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n")), "by_part")
    totals = {r["queue"]: r["n"] for r in by_part.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    # a row per queue and partition of the input: a few counts, whatever the number of documents
    bases = by_part.selectExpr("queue", "part", "sum(n) over (partition by queue order by part rows between unbounded preceding and current row) - n as base")
    placed = done.join(F.broadcast(bases) if by_part.count() <= 200_000 else bases, ["queue", "part"])
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("before")).alias("start"), "doc_tokens", "ids")
    return placed.mapInArrow(_pieces([totals.get(k, 0) for k in range(len(queues))], weights, length, with_ids), schema)
