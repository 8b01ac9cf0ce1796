"""Quality rules: counts, and the divergence of a text's histograms from its language's. Built-in functions only.

Words are runs of anything but ASCII white space. A document fails the base rules if it has under 20 words, or if over 30 % of
its words lie in 8-word windows that occur twice or more in it. The method then compares two histograms with those of all
documents of its language, by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1): character classes, and
the common words with one bin for all others. Texts under a minimum length are not judged by it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, packed, unpacked

#: Character classes of a word's characters beside a-z and what is in none of them.
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "stop": "[.,;:!?'\"()-]+", "sign": "[#*$%&|<>@^~=+/_`{}\\[\\]\\\\]+"}
WINDOW = 8
#: Words that make up at least this share of a language's words are common: at most 100 of them.
COMMON = 0.01
#: Languages of so many words have a reference, and in small tables those of at least this share of the documents.
ENOUGH, LANGUAGE = 10_000, 0.01
BUCKETS = 4096


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def odd_chars(text: Column) -> Column:
    """A text's characters but a-z and ASCII white space; all other classes are counted in this much shorter string."""
    return F.regexp_replace(text, "[a-z\\x20\\x09-\\x0D]+", "")


def class_counts(word_chars: Column, odd: Column) -> Column:
    """Characters of each class: a-z, those of CLASSES in order, all others."""
    n = len(CLASSES)
    found = F.array(word_chars - F.length(odd), *(F.length(odd) - F.length(F.regexp_replace(odd, p, "")) for p in CLASSES.values()))
    return let(found, lambda a: F.concat(a, F.array(word_chars - sum((a[k] for k in range(1, n + 1)), a[0]))))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of WINDOW words that occurs twice or more. hashes: of the words, in order."""
    n = F.size(hashes)

    def doubled(h: Column, k: int) -> Column:
        return let(h, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - k), F.slice(x, F.lit(k + 1), F.size(x) - k), lambda a, b: F.xxhash64(a, b)))

    windows = F.when(n > WINDOW, doubled(doubled(doubled(hashes, 1), 2), 4))

    def covered(found: Column) -> Column:
        return let(
            F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda e: F.aggregate(
                F.sort_array(F.transform(F.filter(e, lambda x, k: _same(e, k - 1, x) | _same(e, k + 1, x)), lambda x: x["i"])),
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n")),
                lambda acc: acc["n"],
            ),
        )

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))


def _same(e: Column, k: Column, x: Column) -> Column:
    return F.coalesce(F.get(e, k)["h"] == x["h"], F.lit(False))


def jensen_shannon(pairs: Column) -> Column:
    """Distance of two distributions given as array<struct<p, q>>."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + (part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2)) / 2)
    return F.sqrt(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def references(docs: DataFrame) -> list[dict]:
    """lang, words (word, share), chars (shares), main: for each language of ENOUGH words, or of LANGUAGE of the documents (main).

    Counts cover all documents. Common words are found exactly in two passes: counts of hash buckets leave at most 100 buckets
    a language that can hold one, and only their words are counted themselves, so rare words are never shuffled.
    """
    if "lang" not in docs.columns:
        return []
    base = docs.filter("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    main = {r["lang"] for r in _shares(docs.select("lang")).collect()}
    if not main and base.isEmpty():
        return []
    spark = docs.sparkSession
    parsed = base.select("lang", words(F.col("text")).alias("w"), odd_chars(F.col("text")).alias("odd"))
    parsed = parsed.select("lang", "w", class_counts(F.length(F.array_join("w", "")), F.col("odd")).alias("c"))
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")
    n_classes = len(CLASSES) + 2
    # the class counts of a document go with its first word, so that one pass makes both
    rows = parsed.select("lang", "c", F.posexplode("w").alias("k", "w")).groupBy("lang", bucket.alias("b")).agg(F.count("*").alias("n"), *(F.sum(F.when(F.col("k") == 0, F.col("c")[k])).alias(f"c{k}") for k in range(n_classes))).persist()
    totals = rows.groupBy("lang").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(n_classes)))
    totals = {r["lang"]: r for r in totals.filter((F.col("n") >= ENOUGH) | F.col("lang").isin(*main)).collect()}
    n_words = {k: totals[k]["n"] if k in totals else 0 for k in main | set(totals)}
    floor = F.broadcast(spark.createDataFrame([(k, max(1.0, COMMON * n)) for k, n in n_words.items()], "lang string, least double"))
    hot = spark.createDataFrame([tuple(r) for r in rows.join(floor, "lang").filter("n >= least").select("lang", "b").collect()], "lang string, b int")
    each = base.select("lang", F.explode(words(F.col("text"))).alias("w")).withColumn("b", bucket)
    found: dict[str, list] = {k: [] for k in n_words}
    for r in each.join(F.broadcast(hot), ["lang", "b"], "left_semi").groupBy("lang", "w").agg(F.count("*").alias("n")).join(floor, "lang").filter("n >= least").collect():
        found[r["lang"]].append((-r["n"], r["w"]))
    rows.unpersist()
    share = lambda n, of: n / of if of else 0.0
    out = []
    for k in sorted(n_words):
        top, sums = sorted(found[k]), [totals[k][f"c{i}"] if k in totals else 0 for i in range(n_classes)]
        out.append({"lang": k, "words": [w for _, w in top], "shares": [share(-n, n_words[k]) for n, _ in top], "chars": [share(c, sum(sums)) for c in sums], "main": k in main})
    return out


def _shares(base: DataFrame) -> DataFrame:
    """Languages that have their share of the documents: lang, n."""
    counts = base.groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    return counts.filter(F.col("lang").isNotNull() & (F.col("n") >= LANGUAGE * total))


REFERENCE = "lang:string,words:array<string>,shares:array<double>,chars:array<double>"


def quality(docs: DataFrame, refs: list[dict] | None = None, min_words: int = 20, max_repeated: int = 30, guard_words: int = 100, max_chars: float = 0.3, max_common: float = 0.24) -> DataFrame:
    """Adds to every row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept.

    docs: text, and lang if there is one. refs: from references(); its default is docs themselves. A row without a language is
    compared with the nearest reference of a main language; where there is none, both distances are 0. js_chars and js_words are
    null for texts under guard_words words and for those of a language without a reference, which the method doesn't judge: kept
    is then decided by the base rules. A null
    text counts as empty; texts are taken whole, whatever their length; an empty table gives no row. Equally near references count as one
    distance. Repeated rows each get the same values. Columns of docs that have a result's name are replaced, all others stay as they are.
    """
    refs = references(docs) if refs is None else refs
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept"]
    own = docs.drop(*new)
    step = docs.select(packed(own), F.coalesce("text", F.lit("")).alias("q_text"), lang.alias("q_lang"))
    step = step.select("*", words(F.col("q_text")).alias("q_words"), F.filter(F.split("q_text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("q_lines"))
    step = step.select("*", F.size("q_words").alias("n_words"), F.length(F.array_join("q_words", "")).alias("word_chars"), odd_chars(F.col("q_text")).alias("q_odd"), F.transform("q_words", lambda w: F.xxhash64(w)).alias("q_hashes"))
    kinds = [x.split(":") for x in REFERENCE.split(",")]
    main = [{k: r[k] for k, _ in kinds} for r in refs if r.get("main", True)]
    every = F.from_json(F.lit(json.dumps(main)), f"array<struct<{REFERENCE}>>")
    # a row a language that has a reference
    table = docs.sparkSession.createDataFrame([(r["lang"], tuple(r[k] for k, _ in kinds)) for r in refs], f"q_key string, q_ref struct<{REFERENCE}>")
    step = step.join(F.broadcast(table), F.col("q_lang") == F.col("q_key"), "left")
    of = F.when(F.col("q_lang").isNull(), every).otherwise(F.array("q_ref"))
    nearest = lambda one: F.coalesce(F.array_min(F.transform(of, one)), F.lit(0.0))
    chars = let(class_counts(F.col("word_chars"), F.col("q_odd")), lambda c: nearest(lambda r: jensen_shannon(F.transform(r["chars"], lambda q, k: F.struct((F.get(c, k) / F.col("word_chars")).alias("p"), q.alias("q"))))))
    n = F.col("n_words")

    def common(r: Column) -> Column:
        known_words = r["words"]
        hit = F.filter("q_words", lambda w: F.array_contains(known_words, w))
        bins = lambda c: F.zip_with(known_words, r["shares"], lambda w, q: F.struct(((F.size(c) - F.size(F.array_remove(c, w))) / n).alias("p"), q.alias("q")))
        rest = lambda c: F.struct(((n - F.size(c)) / n).alias("p"), F.greatest(F.lit(0.0), 1 - F.aggregate(r["shares"], F.lit(0.0), lambda acc, q: acc + q)).alias("q"))
        return let(hit, lambda c: jensen_shannon(F.concat(bins(c), F.array(rest(c)))))

    judged = (n >= guard_words) & (F.col("q_lang").isNull() | F.col("q_key").isNotNull())
    step = step.select(
        "row",
        n.cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        (F.length("q_odd") - F.length(F.regexp_replace("q_odd", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("q_hashes")).cast("long").alias("n_repeat_words"),
        F.when(judged, chars).alias("js_chars"),
        F.when(judged, nearest(common)).alias("js_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    diverges = F.coalesce((F.col("js_chars") > max_chars) | (F.col("js_words") > max_common), F.lit(False))
    step = step.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~diverges)
    return step.select(*unpacked(own), *new)
