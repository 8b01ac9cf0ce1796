"""Citations: bibliography rows, inline citations, offline checks and catalogue scores."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

HEADER = r"(?im)^\s*(?:References|Bibliography|Works?\s+Cited|Literature|Bibliograf[íi]a|R[ée]f[ée]rences)\s*$"
INLINE_HEADER = r"(?i)\b(?:References|Bibliography|Works?\s+Cited)\b"
APA = r"(?m)^(.{5,300}?)\s*\((\d{4}[a-z]?)\)\.\s*([^.]{5,500}\.)"
DOI = r"(?i)(?:doi:\s*|https?://doi\.org/)(10\.\d{4,}/[^\s,;]+)"
PAREN = r"\(([A-Z][a-zA-Z\-]+[^()]{0,60}?\d{4}[a-z]?)\)"
AUTHOR_YEAR = r"([A-Z][a-zA-Z\-]+(?:\s+et\s+al\.?)?(?:\s+(?:and|&)\s+[A-Z][a-zA-Z\-]+)?)\s*\((\d{4}[a-z]?)\)"


def split_bibliography(text: Column) -> Column:
    """struct(body, bib): at a header line, else at the last header word after 30 %, else the last 30 % (the body is then all)."""
    lined = F.split(text, HEADER, 2)
    start = F.floor(F.length(text) * 0.3).cast("int")
    tail = F.substring(text, start + 1, F.length(text))
    parts = F.split(tail, INLINE_HEADER)
    last = F.element_at(parts, -1)
    words = C.matches(tail, INLINE_HEADER)
    inline = F.struct(F.substring(text, F.lit(1), F.length(text) - F.length(last) - F.length(F.element_at(words, -1))).alias("body"), last.alias("bib"))
    rest = F.struct(text.alias("body"), F.substring(text, F.floor(F.length(text) * 0.7).cast("int") + 1, F.length(text)).alias("bib"))
    return F.when(F.size(lined) == 2, F.struct(F.get(lined, F.lit(0)).alias("body"), F.get(lined, F.lit(1)).alias("bib"))).otherwise(F.when(F.size(words) > 0, inline).otherwise(rest))


def references(text: Column) -> Column:
    """array<struct<position, raw, authors, year, title, doi>> of author (year). title. rows."""
    bib = F.regexp_replace(split_bibliography(text)["bib"], r"(?i)^\s*(?:References|Bibliography|Works?\s+Cited|Literature)\s*", "")
    raws = C.matches(bib, APA)
    row = lambda r, i: F.struct(
        i.alias("position"), C.trimmed(r).alias("raw"), C.trimmed(F.regexp_extract(r, APA, 1)).alias("authors"), F.substring(F.regexp_extract(r, APA, 2), 1, 4).cast("int").alias("year"),
        F.regexp_replace(C.trimmed(F.regexp_extract(r, APA, 3)), r"\.+$", "").alias("title"), F.regexp_extract(r, DOI, 1).alias("doi"),
    )
    return F.transform(raws, row)


NUMBERED = r"(?s)\[(\d+)\]\s*(.+?)(?:\n\n|\n(?=\[\d+\])|\z)"


def numbered(text: Column) -> Column:
    """array<struct<position, raw, year, title>> of [n] rows: the quoted title, else the longest part between stops, cut at 200."""

    def row(r: Column) -> Column:
        raw = C.trimmed(F.regexp_extract(r, NUMBERED, 2))
        quoted = F.regexp_extract(raw, "[\"“]([^\"”]+)[\"”]", 1)
        longest = F.reduce(F.split(raw, "[.!?]"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
        year = F.regexp_extract(raw, r"\b((?:19|20)\d{2})\b", 1)
        return F.struct(F.regexp_extract(r, NUMBERED, 1).cast("int").alias("position"), raw.alias("raw"), F.when(year != "", year).cast("int").alias("year"), F.when(quoted != "", C.trimmed(quoted)).otherwise(F.substring(C.trimmed(longest), 1, 200)).alias("title"))

    return F.transform(C.matches(split_bibliography(text)["bib"], NUMBERED), row)


def inline(body: Column) -> Column:
    """Citations in the text, first seen first: (Name, 2023) as it stands, Name (2023) as Name, 2023."""
    named = F.zip_with(C.matches(body, AUTHOR_YEAR, 1), C.matches(body, AUTHOR_YEAR, 2), lambda a, y: F.concat(C.trimmed(a), F.lit(", "), y))
    return F.array_distinct(F.concat(F.transform(C.matches(body, PAREN, 1), C.trimmed), named))


def offline(year: Column, doi: Column, current_year: int) -> Column:
    """struct(score, date_anomaly): 20 for a year before 1900 or after next year, else 50; 20 less for a malformed DOI."""
    odd = F.coalesce((year > current_year + 1) | (year < 1900), F.lit(False))
    bad = (F.coalesce(doi, F.lit("")) != "") & ~doi.rlike(r"^10\.\d{4,}/\S+$")
    return F.struct(F.greatest(F.lit(0.0), F.when(odd, 20.0).otherwise(50.0) - F.when(bad, 20.0).otherwise(0.0)).alias("score"), odd.alias("date_anomaly"))


def surnames(block: str | None) -> list[str]:
    """Lower-case surnames of an author list in the form Surname, I. I., ... & Surname, I."""
    rest = re.sub(r"\bet\s+al\.?", "", block or "", flags=re.IGNORECASE).strip(" .,;&")
    found = []
    for part in re.split(r"\s*(?:&|(?<!\w)and(?!\w)|,)\s*", rest):
        initials = re.fullmatch(r"(?:[A-Z]\.?\s*){1,4}", part.strip() + " ") if part.strip() else True
        name = re.sub(r"[^a-zA-Z-]", "", part).lower()
        if not initials and len(name) >= 2 and name not in {"references", "bibliography", "works", "cited", "literature"}:
            found.append(name)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def author_surnames(blocks: pd.Series) -> pd.Series:
    return blocks.map(surnames)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by longest matching blocks; 1 for two empty ones, 0 if one is."""
    one = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else float(not x and not y)
    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def alnum(text: Column) -> Column:
    return C.trimmed(F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s]", ""))


def confidence(ref: DataFrame) -> DataFrame:
    """Adds confidence (0 to 100) to pairs of a reference and a catalogue work: title, authors, year, journal and c_ columns of the work."""
    title = F.when((F.length("tn") > 0) & (F.length("cn") > 0), sequence_ratio("tn", "cn")).otherwise(0.0)
    out = ref.withColumns({"tn": alnum(F.coalesce("title", F.lit(""))), "cn": alnum(F.coalesce("c_title", F.lit(""))), "jn": alnum(F.coalesce("journal", F.lit(""))), "kn": alnum(F.coalesce("c_journal", F.lit("")))})
    out = out.withColumn("ts", title).withColumn("js", F.when((F.length("jn") > 0) & (F.length("kn") > 0), sequence_ratio("jn", "kn")))
    have, known = F.size(F.coalesce("authors", F.array())), F.size(F.coalesce("c_authors", F.array()))
    share = F.size(F.array_intersect("authors", "c_authors")) / F.greatest(have, F.lit(1))
    authors = F.when((have > 0) & (known > 0), share * 30 - F.when((share < 0.5) & (F.col("ts") > 0.85), 20).otherwise(0) - 15 * F.size(F.array_except("authors", "c_authors"))).when(have > 0, 10.0).otherwise(0.0)
    gap = F.abs(F.col("year") - F.col("c_year"))
    year = F.when(gap == 0, 15).when(gap <= 1, 10).when(gap > 1, 5).otherwise(0)
    journal = F.coalesce(F.col("js") * 15 - F.when(F.col("js") < 0.5, 15).otherwise(0), F.lit(0.0))
    score = F.col("ts") * 40 - F.when(F.col("ts") < 0.5, 20).otherwise(0) + authors + year + journal
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).drop("tn", "cn", "jn", "kn", "ts", "js")


def candidates(refs: DataFrame, works: DataFrame, top: int = 3) -> DataFrame:
    """refs (ref_id, title, ...) with the `top` works that share most title words, ties by work_id; without one its columns are null.

    works: work_id, c_title, c_authors, c_year, c_journal. All words of three characters or more count. Titles of the same words
    are one, and of their works the first `top` alone can win. Titles that share two words or more meet at pairs of words; of
    those that share one word the first `top` works of each word are enough.
    """
    from pyspark.sql import Window

    words = lambda title: F.array_sort(F.array_distinct(F.filter(F.split(alnum(F.col(title)), r"\s+"), lambda w: F.length(w) > 2)))
    ours = refs.select("ref_id", words("title").alias("set")).filter(F.size("set") > 0)
    first = lambda df, key, order: df.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("r") <= top).drop("r")
    theirs = works.select("work_id", words("c_title").alias("c_set")).filter(F.size("c_set") > 0)
    # partial aggregates, as a common title or word has many works
    least = lambda df, key: df.groupBy(key, F.pmod(F.xxhash64("work_id"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_set("work_id")), 1, top).alias("ids")).groupBy(key).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top).alias("ids"))
    titles = least(theirs, "c_set")
    pairs = lambda c: F.flatten(F.transform(F.col(c), lambda a, i: F.transform(F.slice(F.col(c), i + 2, F.size(c)), lambda b: F.concat_ws(" ", a, b))))
    met = ours.select("set").distinct().select("set", F.explode(pairs("set")).alias("w")).join(titles.select("c_set", F.explode(pairs("c_set")).alias("w")), "w")
    met = met.select("set", "c_set").distinct().join(titles, "c_set").select("set", F.size(F.array_intersect("set", "c_set")).alias("shared"), F.explode("ids").alias("work_id"))
    single = least(theirs.select("work_id", F.explode("c_set").alias("w")), "w")
    one = ours.select("set").distinct().select("set", F.explode("set").alias("w")).join(single, "w").select("set", F.lit(1).alias("shared"), F.explode("ids").alias("work_id"))
    found = met.unionByName(one).groupBy("set", "work_id").agg(F.max("shared").alias("shared"))
    best = ours.join(first(found, "set", (F.desc("shared"), "work_id")), "set").select("ref_id", "work_id")
    return refs.join(best, "ref_id", "left").join(works, "work_id", "left")


def features(text: Column, current_year: int, least: int = 50) -> Column:
    """struct of citation features that need no catalogue: total, mean and least score, odd dates, bad DOIs, share not cited inline."""

    def of(v: Column) -> Column:
        refs, cites = v["refs"], F.lower(F.array_join(v["cites"], "\n"))
        checks = F.transform(refs, lambda r: offline(r["year"], r["doi"], current_year))
        first = lambda r: F.lower(F.regexp_extract(r["authors"], r"([A-Za-z-]{2,})", 1))
        missing = F.filter(refs, lambda r: (first(r) != "") & ~F.contains(cites, first(r)))
        n = F.size(refs)
        return F.struct(
            n.cast("double").alias("total_references"), C.mean(F.transform(checks, lambda c: c["score"])).alias("mean_confidence"), F.coalesce(F.array_min(F.transform(checks, lambda c: c["score"])), F.lit(0.0)).alias("min_confidence"),
            F.size(F.filter(checks, lambda c: c["date_anomaly"])).cast("double").alias("date_anomaly_count"), F.when(n > 0, F.size(missing) / n).otherwise(0.0).alias("missing_inline_ratio"),
        )

    none = F.when(F.size(C.tok_ws(text)) < least, F.array().cast("array<struct<position:int,raw:string,authors:string,year:int,title:string,doi:string>>"))
    return C.let(F.struct(F.coalesce(none, references(text)).alias("refs"), inline(split_bibliography(text)["body"]).alias("cites")), of)
