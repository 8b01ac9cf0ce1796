"""Filter interaction audit: what each filter of a chain removes, in every order that the filters can be applied in.

A document's failures are a mask, a bit a filter. All that an order of filters does to a document follows from its mask, so the
corpus shrinks to histograms of masks: a row for each part and for each of all, good and toxic documents, a column a mask. The
outcomes of all orders and steps are then products of these rows with fixed integer incidence matrices, a row a mask and a
column an order and step.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from .common import Scratch, lookup

#: Parts whose outcomes are made at once.
AT_ONCE = 64


def orders(filters: str) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def matrices(filters: str) -> dict[str, np.ndarray]:
    """kept, removed, redundant, unique, shapley: a row a mask (bit k: the k-th filter fails), a column an order and step."""
    masks = np.arange(1 << len(filters))[:, None]
    own = np.array([[1 << filters.index(f) for f in order] for order in orders(filters)])
    before = np.cumsum(own, axis=1) - own
    own, before = own.ravel()[None], before.ravel()[None]
    fails, gone = (masks & own) != 0, (masks & before) != 0
    removed = fails & ~gone
    over = {1 << k: removed[:, own[0] == 1 << k].sum(1) for k in range(len(filters))}  # an order has each filter once
    out = {"kept": ~fails & ~gone, "removed": removed, "redundant": fails & gone, "unique": masks == own, "shapley": np.stack([over[f] for f in own[0].tolist()], 1)}
    return {k: v.astype(np.int64) for k, v in out.items()}


def failures(text: Column) -> Column:
    """Bits of the filters that judge a text by itself. A: under 50 words; B: under 65 % distinct words; C: over 5 % capitals; D: a symbol."""
    words = F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")
    bit = lambda k, fails: F.when(fails, 1 << k).otherwise(0)

    def of(w: Column) -> Column:
        n = F.size(w)
        return bit(0, n < 50) + bit(1, 100 * F.size(F.array_distinct(w)) < 65 * n)

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return let(words, of) + bit(2, 100 * capitals > 5 * F.length(text)) + bit(3, text.rlike("[#$%&*|]"))


def _outcomes(filters: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, names = matrices(filters), orders(filters)
        steps = len(filters)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                rows = {c: np.array(some.column(c).to_pylist(), np.int64).reshape(some.num_rows, -1) for c in ("n", "good", "toxic")}
                found = {"kept": rows["n"] @ of["kept"], "removed": rows["n"] @ of["removed"], "redundant": rows["n"] @ of["redundant"], "unique_fails": rows["n"] @ of["unique"],
                         "good_lost": rows["good"] @ of["removed"], "toxic_lost": rows["toxic"] @ of["removed"], "shapley": rows["n"] @ of["shapley"]}
                columns = [pa.array(np.repeat(some.column("part").to_pylist(), len(names) * steps), pa.string()), pa.array(np.tile(np.repeat(names, steps), some.num_rows)), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names) * some.num_rows))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.ravel()) for x in found.values())], names=["part", "filter_order", "step", *found])

    return run


def outcomes(counts: DataFrame, filters: str) -> DataFrame:
    """part, filter_order, step and the outcomes. counts: part, mask (from 0), n, good, toxic; rows of one part and mask add up."""
    sums = counts.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    masks = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    by = lambda c: F.transform(masks, lambda m: F.coalesce(F.try_element_at("held", m)[c], F.lit(0).cast("long"))).alias(c)
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # a row a mask at most
    rows = sums.groupBy("part").agg(held.alias("held")).select("part", by("n"), by("good"), by("toxic"))
    return rows.mapInArrow(_outcomes(filters), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch, judge: Callable[[Column], Column] = failures, judged: str = "ABCD", repeats: str = "E") -> DataFrame:
    """One row per source value, order of all filters and step: documents kept after it, removed there, redundant (fail its
    filter, gone before), unique_fails (fail it alone), good_lost and toxic_lost (removed there, so labelled), shapley (removed by
    its filter, summed over all orders).

    docs: doc_id, text, source; judge gives a text's bits of the filters in `judged`, `repeats` fails for a text that a smaller
    doc_id has too. labels: doc_id, quality, toxic; other columns of either play no part. A null text counts as empty, a null
    source as the empty string. Rows without doc_id have no label, fail `repeats` never and make no other row fail it; rows that
    repeat a doc_id are documents of their own, and don't fail for one another. Of several label rows of a doc_id any that says
    1 counts; null labels say nothing. An empty table has no part and gives no row. Texts are taken whole, read once, and not
    moved: their digests are.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), judge(text).alias("mask"))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    joined = own.join(said, F.col("doc_id") == F.col("labelled"), "left")
    light = scratch.table(joined.select("doc_id", "part", "digest", "mask", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic"))), "light")
    named = light.filter("doc_id is not null")
    first = scratch.table(named.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1"), "first")
    again = lookup(named, first, "digest", "copies", light.count()).filter("doc_id > first")
    # a repeat moves from its mask to that with the last bit
    moved = again.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.lit(-1).alias("by")), F.struct((F.col("mask") + (1 << len(judged))).alias("mask"), F.lit(1).alias("by")))).alias("x"))
    counts = light.select("part", "mask", "good", "toxic", F.lit(1).alias("by")).union(moved.select("part", "x.mask", "good", "toxic", "x.by"))
    return outcomes(counts.groupBy("part", "mask").agg(F.sum("by").alias("n"), F.sum(F.col("good") * F.col("by")).alias("good"), F.sum(F.col("toxic") * F.col("by")).alias("toxic")), judged + repeats)


def sql() -> str:
    """The same in DuckDB SQL, over the tables documents and labels."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    distinct = " AND ".join(f"{a}.f <> {b}.f" for a, b in itertools.combinations("abcde", 2))
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
                     CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
                     + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                     + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
              FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM {", ".join(f"{letters} {x}(f)" for x in "abcde")} WHERE {distinct}),
        s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
                     coalesce(list_sum([1 << (ascii(substr(filter_order, i, 1)) - 65) FOR i IN range(1, step)]), 0)::INTEGER AS before
              FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (SELECT part, filter_order, step, f,
                     sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
                     sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
                     sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
                     sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM h, s GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM r
    """
