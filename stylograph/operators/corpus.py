"""Corpus preparation: labels, n-gram dictionary, near-duplicate removal, splits, class weights, attacks."""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..session import Stage

LABEL_COLUMNS, DOMAIN_COLUMNS = ("model", "target_model", "label"), ("idiom", "domain", "source")


def resolve(columns: list[str], wanted: str | None, known: tuple[str, ...], required: bool = False) -> str | None:
    """The first column that exists: the wanted one, then those known."""
    for c in (wanted, *known):
        if c and c in columns:
            return c
    if required:
        raise ValueError(f"none of {[wanted, *known]} is a column; there are {columns}")
    return None


def label_rows(df: DataFrame, label_col: str | None = None, domain_col: str | None = None) -> DataFrame:
    """text, label (a family of LABELS_V7), domain, and group_id if there is one. Rows of unknown families and blank texts go."""
    label = resolve(df.columns, label_col, LABEL_COLUMNS, required=True)
    domain = resolve(df.columns, domain_col, DOMAIN_COLUMNS)
    out = df.select("text", C.family(F.col(label), L.FAMILIES_V7).alias("label"), (F.col(domain).cast("string") if domain else F.lit(None).cast("string")).alias("domain"), *(["group_id"] if "group_id" in df.columns else []))
    return out.filter(F.col("label").isNotNull() & F.col("text").rlike(r"(?U)\S"))


#: Different n-grams that a task's Python holds.
HELD = 200_000


def _counted(orders: tuple[int, ...]):
    """n, ngram, cnt of texts whose words are joined by spaces; an n-gram has a row for each time that HELD is reached, at least."""

    def table(n: int, found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n), pa.int32()), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["n", "ngram", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: Counter() for n in orders}
        for batch in batches:
            for text in batch.column("w"):
                w = text.as_py().split(" ")
                for n, found in held.items():
                    found.update(map(" ".join, zip(*(w[i:] for i in range(n)), strict=False)))
                    if len(found) >= HELD:
                        yield table(n, found)
                        found.clear()
        yield from (table(n, found) for n, found in held.items())

    return run


def ngram_counts(docs: DataFrame, text_col: str = "text", orders: tuple[int, ...] = (2, 3, 4), min_words: int = 20) -> DataFrame:
    """n, ngram, cnt over all documents of at least min_words words. Partial counts are made before the shuffle, first of each Arrow batch."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.filter(F.size(C.tok_ws(t)) >= min_words).select(F.array_join(C.tok_word(t), " ").alias("w"))
    return words.mapInArrow(_counted(orders), "n int, ngram string, cnt long").groupBy("n", "ngram").agg(F.sum("cnt").alias("cnt"))


def ngram_dictionary(docs: DataFrame, top: int = 100_000, stage: Stage | None = None, **kw) -> DataFrame:
    """The `top` most frequent n-grams of each order; ties by n-gram. Counts are made once and written.

    The least count that reaches the top is found from how many n-grams have each count, a small table; only those at that count
    are ranked, so no order is sorted as a whole in one task.
    """
    counts = (stage or Stage(docs.sparkSession, "ngrams")).table(ngram_counts(docs, **kw), "counts")
    by = counts.groupBy("n", "cnt").agg(F.count("*").alias("types"))
    upto = by.withColumn("above", F.coalesce(F.sum("types").over(Window.partitionBy("n").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = F.broadcast(upto.filter((F.col("above") < top) & (F.col("above") + F.col("types") >= top)).select(F.col("n").alias("n_"), F.col("cnt").alias("edge"), (F.lit(top) - F.col("above")).alias("room")))
    marked = counts.join(edge, F.col("n") == F.col("n_"), "left")
    sure = marked.filter(F.col("edge").isNull() | (F.col("cnt") > F.col("edge"))).select("n", "ngram", "cnt")
    # ties are ranked in slices first, so that the last rank has at most 64 times the room
    tied = marked.filter(F.col("cnt") == F.col("edge")).withColumn("cell", F.pmod(F.xxhash64("ngram"), F.lit(64)))
    some = tied.withColumn("k", F.row_number().over(Window.partitionBy("n", "cell").orderBy("ngram"))).filter("k <= room")
    ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("ngram"))).filter("k <= room").select("n", "ngram", "cnt")
    return sure.unionByName(ranked)


def dictionary_perplexity(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.01) -> DataFrame:
    """id, ppl: 2 ** (-mean log2 of smoothed n-gram probabilities + 1/tokens), held within .1 and 15."""
    sizes = F.broadcast(dictionary.groupBy("n").agg(F.sum("cnt").alias("total"), F.count("*").alias("types")))
    words = docs.select(F.col(id_col).alias("id"), C.tok_word(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).filter(F.size("w") >= 3)
    each = words.select("id", F.size("w").alias("len"), F.explode(F.array(*(F.struct(F.lit(n).alias("n"), C.ngrams(F.col("w"), n).alias("g")) for n in (2, 3, 4)))).alias("x")).select("id", "len", "x.n", F.explode("x.g").alias("ngram"))
    found = each.join(sizes, "n").join(dictionary.select("n", "ngram", "cnt"), ["n", "ngram"], "left")
    p = (F.coalesce("cnt", F.lit(0)) + alpha) / (F.col("total") + alpha * F.col("types"))
    return found.groupBy("id", "len").agg(F.avg(F.log2(p)).alias("lp")).select("id", F.least(F.lit(15.0), F.greatest(F.lit(0.1), F.pow(F.lit(2.0), -F.col("lp") + 1 / F.col("len")))).alias("ppl"))


# near duplicates
PERMUTATIONS, BANDS = 64, 16
SALTS = [(p * 0x9E3779B1) & 0xFFFFFFFF for p in range(PERMUTATIONS)]


#: Shingles whose hashes a task keeps in mind.
KNOWN = 1_000_000


def minhash(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds sig, array<bigint> of 64: least (low 32 bits of a shingle's MD5) xor salt over 5-character shingles of the lower-cased text."""

    @F.pandas_udf("array<bigint>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        salts = np.array(SALTS, np.uint32)
        known: dict[str, int] = {}

        def hashed(shingle: str) -> int:
            h = int.from_bytes(hashlib.md5(shingle.encode("utf-8", "surrogatepass")).digest()[12:], "big")
            if len(known) < KNOWN:
                known[shingle] = h
            return h

        def one(text: str | None) -> list[int]:
            t = " ".join((text or "").lower().split())
            shingles = {t[i : i + 5] for i in range(max(1, len(t) - 4))}
            h = np.fromiter((known[s] if s in known else hashed(s) for s in shingles), np.uint32, len(shingles))
            low = np.full(len(salts), 0xFFFFFFFF, np.uint32)
            for i in range(0, len(h), 1 << 16):
                low = np.minimum(low, np.bitwise_xor.outer(salts, h[i : i + (1 << 16)]).min(1))
            return low.astype(np.int64).tolist()

        for texts in batches:
            yield texts.map(one)

    return docs.withColumn("sig", signature(F.col(text_col)))


def band_keys(sig: Column) -> Column:
    """The distinct bands, without their number: any band may match any other."""
    rows = PERMUTATIONS // BANDS
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.md5(F.array_join(F.slice(sig, b * rows + 1, rows).cast("array<string>"), ",").cast("binary"))))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids that are kept, of rows of id and key in the order of ids; held: the band has an earlier kept document already."""
    kept: list = []
    taken: set[bytes] = set()
    now, keys, hit = None, [], False

    def decided() -> None:
        if keys and not hit and taken.isdisjoint(keys):
            kept.append(now)
            taken.update(keys)

    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        for i, key, held in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("held").to_pylist(), strict=True):
            if i != now:
                decided()
                now, keys, hit = i, [], False
            keys.append(key)
            hit = hit or held
    decided()
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(kept, kind)], names=["id"])


def drop_near_duplicates(docs: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text", local_rows: int = 1_000_000) -> DataFrame:
    """The documents a greedy pass in id order keeps: each is dropped if it shares a band with an earlier kept one.

    Equal signatures share all bands, so only the first of them takes part, and a document alone in its bands is kept at once. The rest
    are decided in rounds: one with an earlier kept neighbour is dropped, one without an earlier undecided one is kept. Neighbours meet at
    their band, never as pairs: a band's least undecided and least kept document say all that its members need. A round reads the
    bands of undecided documents alone; once they have local_rows rows or fewer, one task finishes them in order, however long their
    chains. Rows that repeat an id go together; ids and texts that are null are left out.
    """
    known = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"(?U)\S")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stage.table(minhash(known, "text").select("id", band_keys(F.col("sig")).alias("keys"), F.md5(F.array_join(F.col("sig").cast("array<string>"), ",").cast("binary")).alias("s")), "signed")
    first = signed.groupBy("s").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    members = stage.table(first.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")), "members")  # an id has a row a text of its own
    each = members.select("id", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    now = stage.table(each.join(shared, "key", "left_semi").select("id", "key"), "bands0")
    kept = [members.join(now.select("id").distinct(), "id", "left_anti").select("id")]
    closed = stage.table(now.filter("false"), "closed0")  # bands of kept documents
    for k in itertools.count(1):  # a round decides the least undecided document at least, so this ends
        rows = now.count()
        held = now.join(closed.select(F.col("key").alias("c_key"), F.lit(True).alias("closed")), F.col("key") == F.col("c_key"), "left").select("id", "key", F.coalesce("closed", F.lit(False)).alias("held"))
        if rows <= local_rows:
            kept.append(stage.table(held.repartition(1).sortWithinPartitions("id").mapInArrow(_greedy, f"id {dict(now.dtypes)['id']}"), "last"))
            break
        least = now.groupBy(F.col("key").alias("l_key")).agg(F.min("id").alias("first_open"))
        seen = held.join(least, F.col("key") == F.col("l_key")).groupBy("id").agg(F.max("held").alias("hit"), F.max(F.col("first_open") < F.col("id")).alias("wait"))
        state = stage.table(seen.filter("hit or not wait").select("id", (~F.col("hit")).alias("kept")), f"state{k}")
        chosen = state.filter("kept").select("id")
        kept.append(chosen)
        closed = stage.table(closed.unionByName(now.join(chosen, "id", "left_semi")), f"closed{k}")
        now = stage.table(now.join(state, "id", "left_anti"), f"bands{k}")
    every = kept[0]
    for part in kept[1:]:
        every = every.unionByName(part)
    return docs.join(every.select(F.col("id").alias(id_col)), id_col, "left_semi")


# splits and weights
def group_key(df: DataFrame, text_col: str = "text") -> Column:
    """group_id, else domain, else a digest of the text's first 80 normalised characters. Null values fall through."""
    prefix = F.substring(F.md5(F.substring(F.lower(F.regexp_replace(F.col(text_col), r"(?U)\s+", " ")), 1, 80).cast("binary")), 1, 12)
    return F.coalesce(*(F.col(c).cast("string") for c in ("group_id", "domain") if c in df.columns), prefix)


def split_groups(df: DataFrame, key: Column, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: the groups in the order of a seeded digest give the first int(n * test) to test, then val, the rest to train."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("k_")).cast("binary"))
    groups = df.select(key.alias("k_")).distinct().withColumn("o_", order).withColumn("cell_", F.substring("o_", 1, 3))
    cells = groups.groupBy("cell_").agg(F.count("*").alias("c"))  # 4,096 at most
    before = F.broadcast(cells.select(F.col("cell_"), (F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("cell_")) - F.col("c")).alias("before_"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n_")))
    rank = F.col("before_") + F.row_number().over(Window.partitionBy("cell_").orderBy("o_", "k_"))
    ranked = groups.join(before, "cell_").withColumn("rank_", rank)
    n_test, n_val = F.floor(F.col("n_") * test), F.floor(F.col("n_") * val)
    named = ranked.select("k_", F.when(F.col("rank_") <= n_test, "test").when(F.col("rank_") <= n_test + n_val, "val").otherwise("train").alias("split"))
    return df.withColumn("k_", key).join(named, "k_").drop("k_")


def split_random(id_col: Column, share: float = 0.1, seed: int = 42) -> Column:
    """test or train by a seeded digest of the id, so that a row keeps its side whatever else is in the table."""
    cell = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")
    return F.when(cell < int(share * 0x1000000), "test").otherwise("train")


def class_weights(labels: DataFrame, column: str = "label") -> DataFrame:
    """label, n, w_v6 (median count / n), w_v7 (sqrt(total / (n + 1)), normalised to mean 1; the total counts the added ones)."""
    c = labels.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row a class
    root = F.sqrt(F.sum(F.col("n") + 1).over(every) / (F.col("n") + 1))
    return c.withColumn("r", root).select("label", "n", (F.lit(float(L.MEDIAN_CLASS_COUNT)) / F.col("n")).alias("w_v6"), (F.col("r") / F.avg("r").over(every)).alias("w_v7"))


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word, less a silent final e; at least 1."""
    groups = F.regexp_count(word, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), groups - (word.rlike("[^l]e$") & (groups > 1)).cast("int"))


def flesch_kincaid(text: Column, chars: int | None = 3000) -> Column:
    """Grade of the first 3,000 characters, as the training label is defined, or of whole texts (chars None); held within -5 and 30, one place; 0 for blank texts."""
    whole = C.one_letter(F.coalesce(text, F.lit("")))
    t = whole if chars is None else F.substring(whole, 1, chars)
    # halves go away from zero by the grade's tenfold: 29.85 is just under itself as a double
    tenth = lambda x: F.when(x < 0, -F.floor(0.5 - x * 10)).otherwise(F.floor(x * 10 + 0.5)) / 10.0
    return C.let(C.matches(F.lower(t), "[a-z']+"), lambda w: F.when(F.size(w) == 0, 0.0).otherwise(
        C.let(F.greatest(F.lit(-5.0), F.least(F.lit(30.0), 0.39 * F.size(w) / F.greatest(F.lit(1), F.size(C.sent_punct(t))) + 11.8 * F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x)) / F.size(w) - 15.59)), tenth)
    ))


# attacks: deterministic, by a draw from id, position and name that SQL can repeat
def _seed(key: Column, name: str) -> Column:
    """What the draws of that name about a row have in common."""
    return F.pmod(F.pmod(key, F.lit(1_000_003)) * 7919 + F.lit(zlib.crc32(name.encode())).cast("long"), F.lit(1_000_003))


def _drawn(seed: Column, i: Column) -> Column:
    y = F.pmod(seed + i.cast("long") * 104_729, F.lit(1_000_003))
    return y * (y + 12_345) % 999_983 % 10_000


def draw(key: Column, i: Column | int, name: str) -> Column:
    """A number from 0 to 9,999 for the i-th choice of that name about a row."""
    return _drawn(_seed(key, name), i if isinstance(i, Column) else F.lit(i))


def inverse_confusables() -> tuple[str, str]:
    """Latin letters, and for each the first look-alike that the table has."""
    first = {}
    for a, b in zip(L.CONFUSABLE_FROM, L.CONFUSABLE_TO, strict=True):
        first.setdefault(b, a)
    return "".join(first), "".join(first.values())


def _each_char(text: Column, key: Column, name: str, rate: float, change, only=None) -> Column:
    """only: which characters change can alter; for the others nothing is drawn."""

    def one(seed: Column, c: Column, i: Column) -> Column:
        drawn = _drawn(seed, i) < int(rate * 10_000)
        return F.when(drawn if only is None else only(c) & drawn, change(c)).otherwise(c)

    return C.let(_seed(key, name), lambda seed: F.array_join(F.transform(C.matches(text, "(?s)."), lambda c, i: one(seed, c, i)), ""))


def _swapped(word: Column, at: Column) -> Column:
    """The letters after `at` first ones change places with one another."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.lit(1)), F.substring(word, at + 1, F.lit(1)), F.substring(word, at + 3, F.length(word)))


def _noisy_words(text: Column, key: Column, name: str, rate: float) -> Column:
    def one(w: Column, i: Column) -> Column:
        at = (draw(key, i, name + " at") % (F.length(w) - 1)).cast("int")
        return F.when((F.length(w) > 4) & (draw(key, i, name) < int(rate * 10_000)), _swapped(w, at)).otherwise(w)

    return F.array_join(F.transform(C.tok_ws(text), one), " ")


def _homoglyphs(text: Column, key: Column, name: str, rate: float) -> Column:
    latin, alike = inverse_confusables()
    return _each_char(text, key, name, rate, lambda c: F.translate(c, latin, alike), lambda c: c.isin(*latin))


def attack(text: Column, key: Column, kind: str, rate: float | None = None) -> Column:
    """What evaluation does to a text; a null text stays null.

    homoglyph: .5 of the letters that have a look-alike get it. zero_width: after .1 of the characters. char_noise: in .1 of the words
    of over 4 letters two neighbours change places; words are joined by single spaces. whitespace: two more after .1 of the spaces.
    """
    rate = rate if rate is not None else (0.5 if kind == "homoglyph" else 0.1)
    if kind == "char_noise":
        return _noisy_words(text, key, kind, rate)
    if kind == "homoglyph":
        return _homoglyphs(text, key, kind, rate)
    if kind == "whitespace":
        return _each_char(text, key, kind, rate, lambda c: F.lit("   "), lambda c: c == " ")
    return _each_char(text, key, kind, rate, {"zero_width": lambda c: F.concat(c, F.lit(L.ZERO_WIDTH[0]))}[kind])


def score_drops(docs: DataFrame, kinds: tuple[str, ...], score: Callable[[Column], Column], canonical: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row an attack: mean score of the texts (plain) and under the attack (attacked), what is lost, and what is left of that between
    canonical texts. One pass: the texts themselves are scored once for all attacks.

    Null texts count for nothing. score: of a text; a model's scores are joined in by the caller instead, as columns.
    """
    base = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), *(attack(F.col(text_col), F.col(id_col), k).alias(f"a{i}") for i, k in enumerate(kinds)))
    each = base.select(score(F.col("t")).alias("p"), score(canonical(F.col("t"))).alias("u"), *(score(f(F.col(f"a{i}"))).alias(f"{x}{i}") for i in range(len(kinds)) for x, f in (("q", lambda a: a), ("v", canonical))))
    means = each.agg(*(F.avg(c).alias(c) for c in each.columns))
    rows = (F.struct(F.lit(k).alias("attack"), F.col("p").alias("plain"), F.col(f"q{i}").alias("attacked"), (F.col("p") - F.col(f"q{i}")).alias("lost"), (F.col("u") - F.col(f"v{i}")).alias("left")) for i, k in enumerate(kinds))
    return means.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def score_drop(docs: DataFrame, kind: str, score: Callable[[Column], Column], canonical: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of one attack: plain, attacked, lost, left."""
    return score_drops(docs, (kind,), score, canonical, id_col, text_col).drop("attack")


def augment_v7(text: Column, key: Column, apply: float = 0.5, chars: float = 0.05, glyphs: float = 0.15, glyph_rate: float = 0.3) -> Column:
    """Training noise of the second ensemble: on half of the texts, swaps within words, and on some of those look-alikes."""
    noisy = C.let(_noisy_words(text, key, "aug noise", chars), lambda t: F.when(draw(key, 0, "glyphs") < int(glyphs * 10_000), _homoglyphs(t, key, "aug glyph", glyph_rate)).otherwise(t))
    return F.when(draw(key, 0, "apply") < int(apply * 10_000), noisy).otherwise(text)


def augment_v6(text: Column, key: Column, apply: float = L.AUGMENT_V6["apply"], chars: float = L.AUGMENT_V6["chars"], merge: float = L.AUGMENT_V6["merge"], least: int = L.AUGMENT_V6["least"]) -> Column:
    """Training noise of the first ensemble: words of `least` letters or more have two letters swapped, one deleted or one inserted; a word may take in the next."""
    words = C.tok_ws(text)

    def noisy(w: Column, i: Column) -> Column:
        at = (draw(key, i, "v6 at") % F.greatest(F.lit(1), F.length(w) - 1)).cast("int")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw(key, i, "v6 letter") % 26).cast("int") + 1, F.lit(1))
        head, tail = F.substring(w, F.lit(1), at), lambda k: F.substring(w, at + k, F.length(w))
        kind = draw(key, i, "v6 kind") % 3
        changed = F.when(kind == 0, _swapped(w, at)).when((kind == 1) & (F.length(w) > 3), F.concat(head, tail(2))).when(kind == 2, F.concat(head, letter, tail(1))).otherwise(w)
        return F.when((F.length(w) >= least) & (draw(key, i, "v6 noise") < int(chars * 10_000)), changed).otherwise(w)

    def joined(ws: Column) -> Column:
        # whether a word takes the next one in is drawn by its place alone, so no word needs what came before it
        merges = lambda i: (draw(key, i, "v6 merge") < int(merge * 10_000)) & (i < F.size(ws) - 1)
        own = lambda w, i: F.when((i > 0) & merges(i - 1), "").otherwise(noisy(w, i))
        out = F.transform(ws, lambda w, i: F.concat(own(w, i), F.when(merges(i), F.get(ws, i + 1)).otherwise("")))
        return F.array_join(F.filter(out, lambda w: w != ""), " ")

    return F.when(draw(key, 0, "v6 apply") < int(apply * 10_000), C.let(words, joined)).otherwise(text)


def expected_threshold(n: int, alpha: float) -> int:
    """The rank that a conformal threshold takes among n scores, from 1."""
    return min(n, max(1, math.ceil((n + 1) * (1 - alpha) - 1e-9)))
