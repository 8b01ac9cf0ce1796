"""Substring dedup: paragraph MinHash banding.

A paragraph is a line of at least min_words words. Its MinHash signature over 5-word shingles is cut into bands, tuned so that a
pair at the similarity threshold collides with at least the asked recall. Equal paragraphs are one node; paragraphs that share a
band are candidates, verified by exact Jaccard similarity of their shingle sets. The removals are clustered by connected
components: the first paragraph of a component stays, all others go. Words are runs of anything but ASCII white space, A-Z in
lower case.

A passage that repeats inside otherwise different lines is no paragraph of its own there. For those, every window of min_words
words counts: each but the first place of its words is removed, in maximal runs that equal one other place word by word. Only
windows whose seed, the least hash of 8 words in them, occurs again can repeat, so only those are compared, in the seed's task;
windows of a seed that is very common are compared one by one, by their own hash. Of documents whose whole texts are equal the first
counts, the others go whole. Runs a few words apart at both places are one near copy if their equal words are enough of it; nothing
else unequal is removed. Windows of one word over and over don't count.

Both parts keep what comes first by (doc_id, text_hash, position), null first, so what is removed always has a place before it. The
second part sees no word of a paragraph that the first removed as a near copy, as its words needn't stay anywhere: it neither is
removed twice nor stands for another place. So the last copy of a passage stays, but for the words in which near copies differ.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, components, lookup, packed, texts

SHINGLE, SIMILARITY, RECALL, MIN_WORDS, PERMUTATIONS, TILE = 5, 0.8, 0.995, 20, 64, 1024
#: Words of a seed; a run that adds fewer words than EDGE to longer ones is left out; most words between two runs of a near copy.
SEED, EDGE, BRIDGE = 8, 4, 8
#: Seeds of more stretches than this are too common for one task: their windows are dealt out by their own hashes.
HOT = 4096


def tune(similarity: float = SIMILARITY, recall: float = RECALL, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach the recall at the threshold within so many permutations."""
    best = None
    for rows in range(1, permutations + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= permutations:
            best = (bands, rows)
    return best or (permutations, 1)


def hashes(text: str) -> np.ndarray:
    """XXH64 of each word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def _spans(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on."""
    out, at, n = None, 0, len(h) - k + 1
    width = 1
    while True:
        if k & width:
            part = h[at : at + n]
            out = part if out is None else _mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
            at += width
        if (width := 2 * width) > k:
            return out
        h = _mix(h[: -(width // 2)] * np.uint64(0xA0761D6478BD642F) + h[width // 2 :])


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """Least of the k values from each place on."""
    n, width = len(h) - k + 1, 1
    while 2 * width <= k:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:n], h[k - width : k - width + n])


def shingles(line: str, size: int = SHINGLE) -> list[int]:
    """Hashes of a line's word shingles; fewer words make one."""
    h = hashes(line)
    return _spans(h, min(size, len(h))).tolist() if len(h) else []


def _lines(text: str, min_words: int) -> Iterator[tuple[int, int, str, int, int]]:
    """(start, end, line, first word, word after the last) of a text's paragraphs."""
    at = word = 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if n >= min_words:
            yield at, at + len(line), line, word, word + n
        at += len(line) + 1
        word += n


def paragraphs(text: str, min_words: int) -> Iterator[tuple[int, int, str]]:
    return (x[:3] for x in _lines(text, min_words))


#: A row a text of min_words words: its extent without outer white space, its paragraphs, and its seeds.
PARSED = (
    "doc_id bigint, key bigint, start int, end int, n_words int, "
    "lines array<struct<start:int,end:int,n_words:int,node:bigint,line:string,bands:array<bigint>>>, seeds array<struct<word:int,node:bigint>>"
)


def _lists(sizes: list[int], names: list[str], columns: list[pa.Array]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names))


def _parsed(min_words: int, bands: int, rows: int, inner: bool):
    """Paragraphs with their bands if there are any, seeds if inner."""
    rng = np.random.default_rng(7)
    odd, add = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def signatures(found: list[np.ndarray]) -> np.ndarray:
        keys = np.empty((len(found), bands), np.uint64)
        if not found:
            return keys
        flat, cuts = np.concatenate(found), np.concatenate(([0], np.cumsum([len(h) for h in found])[:-1]))
        for b in range(bands):
            key = np.full(len(found), b, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                key = (key ^ np.minimum.reduceat(flat * odd[k] + add[k], cuts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys[:, b] = key
        return keys

    def flush(docs: list[tuple], lines: list[tuple], found: list[np.ndarray], places_: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        keys = signatures(found)
        each = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, max(bands, 1), dtype=np.int32)) if bands else pa.array([0], pa.int32()), pa.array(keys.view(np.int64).ravel()))
        own = [pa.array([x[i] for x in lines], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()))]
        seeds = [pa.array(np.concatenate([np.zeros(0, t), *x])) for x, t in ((places_, np.int32), (nodes, np.int64))]
        columns = [pa.array([x[i] for x in docs], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
        columns += [_lists([x[5] for x in docs], ["start", "end", "n_words", "node", "line", "bands"], [*own, each]), _lists([x[6] for x in docs], ["word", "node"], seeds)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "start", "end", "n_words", "lines", "seeds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = ([], [], [], [], []), 0
        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), texts(batch.column("text")), strict=True):
                h = hashes(text)
                if len(h) < min_words:
                    continue
                docs, lines, found, places_, nodes = held
                before = len(lines)
                if bands:
                    all_ = _spans(h, min(SHINGLE, len(h)))
                    for a, b, line, i, j in _lines(text, min_words):
                        lines.append((a, b, j - i, xxhash.xxh64_intdigest(h[i:j].tobytes()) - (1 << 63), line))
                        found.append(all_[i : j - SHINGLE + 1] if j - i >= SHINGLE else _spans(h[i:j], j - i))
                at = np.zeros(0, np.int32)
                if inner:
                    seeds = _window_seeds(h, min_words)
                    at = places(seeds, min_words)
                    places_.append(at.astype(np.int32))
                    nodes.append(seeds[at].view(np.int64))
                docs.append((doc, key, len(text) - len(text.lstrip(WHITE)), len(text.rstrip(WHITE)), len(h), len(lines) - before, len(at)))
                n += len(h)
                if n > 200_000:
                    yield flush(*held)
                    held, n = ([], [], [], [], []), 0
        if held[0]:
            yield flush(*held)

    return run


def _verified(similarity: float):
    """Within each bucket, a spanning forest of the pairs that are similar enough: each is compared with those not yet reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            sets = [frozenset(shingles(line)) for _, line in held]
            rest, found = list(range(len(held))), []
            while rest:
                front, rest = [rest[0]], rest[1:]
                while front and rest:
                    x = sets[i := front.pop()]
                    left = []
                    for j in rest:
                        y = sets[j]
                        common = len(x & y) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                        if common >= similarity * (len(x) + len(y) - common) and common:
                            found.append((held[i][0], held[j][0]))
                            front.append(j)
                        else:
                            left.append(j)
                    rest = left
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("band", "ta", "tb", "node", "line")), strict=True):
                if row[:3] != key:
                    yield from done(held)
                    key, held = row[:3], []
                held.append(row[3:])
        yield from done(held)

    return run


def links(reps: DataFrame, found: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b): verified similar paragraphs, enough to connect all that are connected.

    reps: node, bands and first (the node's first place), a row a node; found: doc_id, key, start and line of the paragraphs.
    """
    keyed = reps.select(F.explode("bands").alias("band"), "node")
    # a band's bucket matters only if another paragraph is in it, which few are
    shared = scratch.table(keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.when(F.col("n") <= tile, 1).otherwise(F.ceil(F.col("n") * 2 / tile)).cast("int").alias("tiles")), "shared")
    inside = scratch.table(keyed.join(shared, "band"), "inside")
    # a node's line is fetched from its first place alone, however many copies it has
    wanted = scratch.table(inside.select("node").distinct().join(reps, "node").select("node", F.col("first.doc_id").alias("w_doc"), F.col("first.key").alias("w_key"), F.col("first.start").alias("w_start")), "wanted_lines")
    at_first = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("key") == F.col("w_key")) & (F.col("start") == F.col("w_start"))
    lines = scratch.table(found.select("doc_id", "key", "start", "line").join(wanted, at_first).select("node", "line").dropDuplicates(["node"]), "lines")
    cut = inside.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("band", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), "node")
    full = cut.join(lines, "node").select("band", "ta", "tb", "node", "line")
    return full.repartition("band", "ta", "tb").sortWithinPartitions("band", "ta", "tb").mapInArrow(_verified(similarity), "a bigint, b bigint")


def _window_seeds(h: np.ndarray, size: int) -> np.ndarray:
    """The seed of each window of size words: the least hash of SEED words in it."""
    k = min(SEED, size)
    return _least(_spans(h, k), size - k + 1)


def places(seeds: np.ndarray, size: int) -> np.ndarray:
    """First windows of the stretches that share a seed: at most as many windows as can share one place of it."""
    at = np.arange(len(seeds))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], seeds[1:] != seeds[:-1])), at, 0))
    return np.flatnonzero((at - first) % (size - min(SEED, size) + 1) == 0)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)], names=[c for c, _ in columns])


#: Windows from a word on: their hashes, and the code points where each begins and ends. Of a common seed, a row a window,
#: whose node is its own hash, with the points of that one.
STRETCH = "node bigint, doc_id bigint, key bigint, word int, hot boolean, start int, end int, hashes binary, starts binary, ends binary"


def _stretches(size: int):
    """The windows of each stretch whose seed occurs again (column found: the stretches' first words), but for those that touch a span of lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, text, wanted, lost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "found", "lost")), strict=True):
                h = hashes(text)
                every, seeds = _spans(h, size), _window_seeds(h, size)
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                gap = np.concatenate(([True], (data == 32) | ((data >= 9) & (data <= 13)), [True]))
                starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
                if not text.isascii():
                    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    starts, ends = point[starts], point[ends]
                starts, ends = starts.astype("<i4"), ends.astype("<i4")
                same = np.concatenate(([0], np.cumsum(h[1:] == h[:-1])))
                live = same[size - 1 :] - same[: len(every)] < size - 1  # not one word over and over
                for x in lost or ():
                    a, b = np.searchsorted(ends, x["start"], "right"), np.searchsorted(starts, x["end"])
                    live[max(0, a - size + 1) : b] = False
                at = places(seeds, size)
                stop = np.append(at[1:], len(seeds))
                hot = {x["word"]: x["hot"] for x in wanted}
                for a, b in zip(at.tolist(), stop.tolist(), strict=True):
                    if (common := hot.get(a)) is None:
                        continue
                    some = a + np.flatnonzero(live[a:b])
                    for part in np.split(some, np.flatnonzero(np.diff(some) > 1) + 1) if len(some) else ():
                        i, j = int(part[0]), int(part[-1]) + 1
                        if common:
                            out += [(int(every[k].view(np.int64)), doc, key, k, True, int(starts[k]), int(ends[k + size - 1]), None, None, None) for k in range(i, j)]
                        else:
                            out.append((int(seeds[i].view(np.int64)), doc, key, i, False, None, None, every[i:j].tobytes(), starts[i:j].tobytes(), ends[i + size - 1 : j + size - 1].tobytes()))
                if len(out) > 20_000:
                    yield _batch(out, STRETCH)
                    out = []
            yield _batch(out, STRETCH)

    return run


MATCH = "doc_id bigint, key bigint, word int, n_words int, start int, end int, kept_doc_id bigint, kept_key bigint, kept_word int, kept_start int, node bigint"


def _matches(size: int):
    """From the stretches of a seed, in order of place: what equals the first place of its windows, joined while that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first = None, {}
        for batch in batches:
            out = []
            for seed, doc, key, word, hashes_, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("node", "doc_id", "key", "word", "hashes", "starts", "ends")), strict=True):
                if seed != node:
                    node, first = seed, {}
                a, b, held = np.frombuffer(starts, "<i4").tolist(), np.frombuffer(ends, "<i4").tolist(), None
                for i, h in enumerate(np.frombuffer(hashes_, np.uint64).tolist()):
                    at = first.setdefault(h, (doc, key, word + i, a[i]))
                    # a place is no repeat of one that it overlaps
                    if at[0] == doc and at[1] == key and word + i - at[2] < size:
                        held = None
                    elif held is not None and held[6] == at[0] and held[7] == at[1] and at[2] - held[8] == word + i - held[2]:
                        held[3], held[5] = word + i - held[2] + size, b[i]
                    else:
                        held = [doc, key, word + i, size, a[i], b[i], *at, node]
                        out.append(held)
            yield _batch(out, MATCH)

    return run


SPAN = "doc_id bigint, key bigint, start int, end int, n_words int, kept_doc_id bigint, kept_start int, component bigint"


def _kept(x: dict) -> tuple:
    return x["kept_doc_id"] is not None, x["kept_doc_id"] or 0, x["kept_key"]


def runs(found: list[dict]) -> list[dict]:
    """A document's matches (as MATCH), joined where they overlap at the same distance from one kept place: maximal equal runs.

    Of runs that overlap the longer counts first, and one that adds under EDGE words to them is a chance extension and left out.
    """
    held: list[dict] = []
    for x in sorted(found, key=lambda x: (_kept(x), x["kept_word"] - x["word"], x["word"])):
        y = held[-1] if held else None
        if y and _kept(y) == _kept(x) and y["kept_word"] - y["word"] == x["kept_word"] - x["word"] and x["word"] <= y["word"] + y["n_words"]:
            if x["word"] + x["n_words"] > y["word"] + y["n_words"]:
                y["n_words"], y["end"] = x["word"] + x["n_words"] - y["word"], x["end"]
        else:
            held.append(dict(x))
    covered = np.zeros(max((x["word"] + x["n_words"] for x in held), default=0), bool)
    out = []
    for x in sorted(held, key=lambda x: (-x["n_words"], x["word"], _kept(x), x["kept_word"])):
        part = covered[x["word"] : x["word"] + x["n_words"]]
        if len(part) - np.count_nonzero(part) >= EDGE:
            part[:] = True
            out.append(x)
    return bridged(out)


def bridged(found: list[dict]) -> list[dict]:
    """Runs that follow one another here and at one other place, up to BRIDGE words apart at both, as one if they are near copies.

    The equal words of both must be SIMILARITY of all words that either place has there.
    """
    out: list[dict] = []
    for x in sorted(found, key=lambda x: x["word"]):
        x = {**x, "equal": x["n_words"], "kept_end": x["kept_word"] + x["n_words"]}
        if out and _kept(y := out[-1]) == _kept(x):
            here, there, equal = x["word"] - y["word"] - y["n_words"], x["kept_word"] - y["kept_end"], y["equal"] + x["equal"]
            apart = (x["kept_doc_id"], x["kept_key"]) != (x["doc_id"], x["key"]) or x["kept_end"] <= y["word"]
            if 0 <= here <= BRIDGE and 0 <= there <= BRIDGE and apart and equal >= SIMILARITY * (x["word"] + x["n_words"] - y["word"] + x["kept_end"] - y["kept_word"] - equal):
                y |= {"n_words": x["word"] + x["n_words"] - y["word"], "end": x["end"], "kept_end": x["kept_end"], "equal": equal}
                continue
        out.append(x)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, key, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "found")), strict=True):
            out += [(doc, key, x["start"], x["end"], x["n_words"], x["kept_doc_id"], x["kept_start"], x["node"]) for x in runs([{**x, "doc_id": doc, "key": key} for x in found])]
        yield _batch(out, SPAN)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of the text, and the text: a document is named by the first two, as doc_id may be null or repeated."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def inner_repeats(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, parsed: DataFrame | None = None, lost: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """Passages that repeat inside lines, as SPAN; see repeats().

    parsed: as _parsed() gives it. lost: doc_id, key, start, end of what neither is removed here nor counts as a place. A seed of
    more than hot stretches is very common.
    """
    base = _keyed(docs)
    if parsed is None:
        parsed = scratch.table(base.mapInArrow(_parsed(min_words, 0, 0, True), PARSED), "parsed")
    n_texts = parsed.count()
    same = scratch.table(parsed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id")).alias("first")).filter("n > 1"), "same")
    copies = lookup(parsed.select("doc_id", "key", "start", "end", "n_words"), same, "key", "n", n_texts).filter(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    copies = scratch.table(copies.select("doc_id", "key", "start", "end", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("start").alias("kept_start"), F.col("key").alias("component")), "copies")
    gone = copies.select(F.col("doc_id").alias("g_doc"), F.col("key").alias("g_key")).distinct()
    first_texts = parsed.select("doc_id", "key", "seeds").join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("key") == F.col("g_key")), "left_anti")
    seeds = scratch.table(first_texts.select("doc_id", "key", F.explode("seeds").alias("s")).select("doc_id", "key", "s.word", "s.node"), "seeds")
    scratch.drop("parsed")
    again = scratch.table(seeds.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").withColumn("hot", F.col("n") > hot), "again")
    wanted = lookup(seeds, again, "node", "n", seeds.count()).groupBy("doc_id", "key").agg(F.collect_set(F.struct("word", "hot")).alias("found"))
    wanted = scratch.table(wanted.withColumnsRenamed({"doc_id": "w_doc", "key": "w_key"}), "wanted")
    scratch.drop("seeds")
    found = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("key") == F.col("w_key"))).select("doc_id", "key", "text", "found")
    if lost is None:
        found = found.withColumn("lost", F.lit(None).cast("array<struct<start:int,end:int>>"))
    else:
        each = lost.groupBy(F.col("doc_id").alias("l_doc"), F.col("key").alias("l_key")).agg(F.collect_set(F.struct("start", "end")).alias("lost"))
        found = found.join(each, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("key") == F.col("l_key")), "left").select("doc_id", "key", "text", "found", "lost")
    stretches = found.mapInArrow(_stretches(min_words), STRETCH)
    common = not again.filter("hot").isEmpty()
    if common:
        stretches = scratch.table(stretches, "stretches")
    matched = stretches.filter("not hot").repartition("node").sortWithinPartitions("node", "doc_id", "key", "word").mapInArrow(_matches(min_words), MATCH)
    if common:
        lone = stretches.filter("hot").select("node", "doc_id", "key", "word", "start", "end")
        firsts = scratch.table(lone.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "word", "start")).alias("f")).filter("n > 1"), "firsts")
        over = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("key") == F.col("f.key")) & (F.col("word") - F.col("f.word") < min_words)
        named = lookup(lone, firsts, "node", "n", lone.count()).filter(~over)
        matched = matched.unionByName(named.select("doc_id", "key", "word", F.lit(min_words).alias("n_words"), "start", "end", F.col("f.doc_id").alias("kept_doc_id"), F.col("f.key").alias("kept_key"), F.col("f.word").alias("kept_word"), F.col("f.start").alias("kept_start"), "node"))
    matched = scratch.table(matched, "matched")
    each = matched.groupBy("doc_id", "key").agg(F.collect_list(F.struct("word", "n_words", "start", "end", "kept_doc_id", "kept_key", "kept_word", "kept_start", "node")).alias("found"))
    return each.mapInArrow(_runs, SPAN).unionByName(copies)


def repeats(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, tile: int = TILE, local_edges: int = 1_000_000, inner: bool = True, hot: int = HOT) -> DataFrame:
    """What to remove: doc_id, text_hash, start, end (code points, end exclusive), n_words, kept_doc_id, kept_start, component, inner.

    inner: a passage inside lines, or a whole text, that repeats word by word; else a paragraph of the banding. The two may overlap.
    Both are found unless inner is False. text_hash, Spark's xxhash64 of the text, tells documents of one doc_id, or of none, apart.

    docs: doc_id bigint, text; other columns are not read. A null text, and one under min_words words, has no paragraph; an empty
    table gives no row; texts of any length are taken whole. Of a component the least (doc_id, text_hash, start) stays, a null
    doc_id counting as least; a paragraph repeated within a document goes too. Rows that repeat doc_id and text share their
    places: all of them stay or all go.
    """
    bands, rows = tune(similarity)
    parsed = scratch.table(_keyed(docs).mapInArrow(_parsed(min_words, bands, rows, inner), PARSED), "parsed")
    heavy = parsed.select("doc_id", "key", F.explode("lines").alias("l")).select("doc_id", "key", "l.*")
    reps = scratch.table(heavy.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("first"), F.first("bands").alias("bands")), "reps")
    joined = components(links(reps, heavy, scratch, similarity, tile), scratch, local_edges)
    named = reps.select("node", "n", "first").join(joined, "node", "left").filter("component is not null or n > 1")
    named = scratch.table(named.select("node", "n", F.coalesce("component", "node").alias("component"), "first"), "members")
    for name in ("reps", "lines", "wanted_lines", "inside", "shared"):
        scratch.drop(name)
    kept = scratch.table(named.groupBy("component").agg(F.count("*").alias("m"), F.min(F.struct("first", "node")).alias("kept")), "kept")
    where = scratch.table(lookup(named, kept, "component", "m", named.count()).select("node", "n", "component", "kept"), "where")
    found = lookup(heavy.select("doc_id", "key", "start", "end", "n_words", "node"), where, "node", "n", heavy.count())
    first = F.col("kept.first")
    out = found.filter(~(F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("key") == first["key"]) & (F.col("start") == first["start"])))
    whole = out.select("doc_id", "key", "start", "end", "n_words", first["doc_id"].alias("kept_doc_id"), first["start"].alias("kept_start"), "component", (F.col("node") != F.col("kept.node")).alias("near"))
    if inner:
        whole = scratch.table(whole, "whole")
        within = inner_repeats(docs, scratch, min_words, parsed, whole.filter("near").select("doc_id", "key", "start", "end"), hot)
        whole = whole.drop("near").withColumn("inner", F.lit(False)).unionByName(within.withColumn("inner", F.lit(True)))
    else:
        whole = whole.drop("near").withColumn("inner", F.lit(False))
    return whole.withColumnRenamed("key", "text_hash")


def _cut(text: str | None, spans: list[dict] | None) -> str | None:
    if not spans or text is None:
        return text
    at, parts = 0, []
    for s in sorted(spans, key=lambda s: s["start"]):
        parts.append(text[at : max(at, s["start"])])
        end = s["end"]
        whole = (s["start"] == 0 or text[s["start"] - 1] == "\n") and text[end : end + 1] in ("", "\n")
        at = max(at, end + whole)  # a whole line goes with its end
    return "".join([*parts, text[at:]])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("row")
        columns = dict(zip((f.name for f in row.type), row.flatten(), strict=True))
        columns["text"] = pa.array(map(_cut, columns["text"].to_pylist(), batch.column("spans").to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs, with spans (doc_id, text_hash, start, end; as repeats() gives them) cut out of text.

    A span is cut from the rows of its doc_id, which may be null, whose text has that hash; other rows of the doc_id stay as they
    are, as do null texts and all other columns, whatever their names.
    """
    each = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "s_doc", "text_hash": "s_hash"})
    keyed = docs.select(packed(docs), F.col("doc_id"), F.xxhash64("text").alias("hash"))
    full = keyed.join(each, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("hash") == F.col("s_hash")), "left").select("row", "spans")
    return full.mapInArrow(_without, docs.schema)
