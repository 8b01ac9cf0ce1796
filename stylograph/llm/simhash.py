"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has 64 bits: bit i is set if it is set in over half the XXH64 hashes (seed 42) of its 4-word shingles. Two
fingerprints link at max_distance differing bits or fewer. Pairs are only formed inside buckets of fingerprints that agree on
some of b blocks of bits: with b - max_distance blocks equal, no linked pair is missed, and b follows the number of
fingerprints so that a bucket stays small. Inside a bucket a table of Hamming distances to fixed reference fingerprints
(the pivots) discards every pair with a coordinate difference over max_distance, which the triangle inequality allows, and the
survivors are verified on the fingerprints. A bucket yields a spanning forest of its links, not all pairs of a group. Buckets
too large for a task are cut into tiles and every pair of tiles is one task's work.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, lookup, texts

WORDS, SEED, BITS = 4, 42, 64
PIVOTS = 24
TILE = 2048


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: XXH64 of the numbers from 0."""
    return np.array([xxhash.xxh64_intdigest(str(k), SEED) for k in range(n)], np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not w:
        return 0
    joined, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    total, n = np.zeros(BITS, np.int64), 0
    while part := [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in itertools.islice(cuts, 1 << 16)]:
        total += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in texts(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fp"])


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each fingerprint's distances to the pivots, one byte each."""
    of = pivots()
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        near = np.bitwise_count(fp[:, None] ^ of[None, :]).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("fp"), pa.array([x.tobytes() for x in near], pa.binary())], names=["fp", "rep", "pivots"])


def blocks_for(n: int, max_distance: int, bucket: int = 256) -> int:
    """Least number of blocks for which an even spread of n fingerprints has buckets of this size or smaller."""
    for b in range(max_distance + 1, max_distance + 9):
        if n / 2 ** (BITS // b * (b - max_distance)) <= bucket:
            return b
    return max_distance + 8


def keys(fp: Column, blocks: int, max_distance: int) -> Column:
    """Array of struct(combo, bits): for each choice of blocks that may be equal, the bits in them."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    out = []
    for i, chosen in enumerate(itertools.combinations(range(blocks), blocks - max_distance)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(i).alias("combo"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return F.array(*out)


def linked(fp: np.ndarray, near: np.ndarray, max_distance: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among fingerprints: every fingerprint is compared with those not yet reached."""
    order = np.argsort(near[:, 0], kind="stable")  # one coordinate in order: a range of it holds all that may link
    rest = order
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            first = near[rest, 0].astype(np.int16)
            a, b = np.searchsorted(first, int(near[x, 0]) - max_distance), np.searchsorted(first, int(near[x, 0]) + max_distance, "right")
            some = rest[a:b]
            some = some[(np.abs(near[some].astype(np.int16) - near[x].astype(np.int16)) <= max_distance).all(1)] if len(some) else some
            some = some[np.bitwise_count(fp[some] ^ fp[x]) <= max_distance]
            if len(some):
                for y in some.tolist():
                    yield int(x), y
                front.extend(some.tolist())
                rest = rest[~np.isin(rest, some)]


def _buckets(max_distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            fp = np.array([x[0] for x in held], np.int64).view(np.uint64)
            rep = [x[1] for x in held]
            near = np.frombuffer(b"".join(x[2] for x in held), np.uint8).reshape(len(held), -1)
            if len(held) <= 64:  # small buckets at once: the whole table of coordinate differences
                i, j = np.triu_indices(len(held), 1)
                keep = np.abs(near[i].astype(np.int16) - near[j].astype(np.int16)).max(1) <= max_distance
                i, j = i[keep], j[keep]
                keep = np.bitwise_count(fp[i] ^ fp[j]) <= max_distance
                found = list(zip(i[keep].tolist(), j[keep].tolist(), strict=True))
            else:
                found = list(linked(fp, near, max_distance))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rep[a] for a, _ in found], pa.int64()), pa.array([rep[b] for _, b in found], pa.int64())], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("combo", "bits", "ta", "tb", "fp", "rep", "pivots")), strict=True):
                if row[:4] != key:
                    yield from done(held)
                    key, held = row[:4], []
                held.append(row[4:])
        yield from done(held)

    return run


def links(reps: DataFrame, n: int, scratch: Scratch, max_distance: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): rep of two linked fingerprints, enough of them to connect all that are connected. reps: fp, rep, pivots; n: its rows."""
    spread = reps.select(F.explode(keys(F.col("fp"), blocks_for(n, max_distance), max_distance)).alias("k"), "fp", "rep", "pivots").select("k.combo", "k.bits", "fp", "rep", "pivots")
    # at most rows / tile keys are large
    large = scratch.table(spread.groupBy("combo", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("combo", "bits", F.ceil(F.col("n") * 2 / tile).cast("int").alias("tiles")), "large")
    if large.isEmpty():
        cut = spread.withColumns({"ta": F.lit(0), "tb": F.lit(0)})
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        cut = scratch.table(spread, "spread").join(large, ["combo", "bits"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("own", own)
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"ta": F.least("own", "other"), "tb": F.greatest("own", "other")})
    cut = cut.select("combo", "bits", "ta", "tb", "fp", "rep", "pivots").repartition("combo", "bits", "ta", "tb").sortWithinPartitions("combo", "bits", "ta", "tb")
    return cut.mapInArrow(_buckets(max_distance), "a bigint, b bigint")


def simhash(docs: DataFrame, scratch: Scratch, max_distance: int = 4, tile: int = TILE, local_edges: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, text_hash (Spark's xxhash64 of the text), fp (bigint of the fingerprint's bits), component (its
    smallest fp), component_id (smallest doc_id reachable).

    docs: doc_id bigint, text; other columns play no part. A null text counts as empty; texts without words have fingerprint zero and
    link like others; texts of any length are taken whole. Equal fingerprints are one node, so copies make no pairs. A row without
    doc_id links like any other, and so may connect rows that have one; it gets the component_id of those (null if there is none).
    Rows of one doc_id with different texts are placed by their texts. Repeated rows each get their row; an empty table gives none.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prints = scratch.table(keyed.mapInArrow(_fingerprints, "doc_id bigint, text_hash bigint, fp bigint"), "prints")
    groups = scratch.table(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    reps = scratch.table(groups.select("fp").mapInArrow(_table, "fp bigint, rep bigint, pivots binary"), "reps")
    found = components(links(reps, reps.count(), scratch, max_distance, tile), scratch, local_edges)
    placed = scratch.table(groups.join(found, groups["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component")), "placed")
    least = scratch.table(placed.groupBy("component").agg(F.count("*").alias("m"), F.min("first").alias("component_id")), "least")
    named = scratch.table(lookup(placed, least, "component", "m", reps.count()).select("fp", "n", "component", "component_id"), "named")
    return lookup(prints, named, "fp", "n", prints.count()).select("doc_id", "text_hash", "fp", "component", "component_id")
