"""Secret scans: three patterns, and a randomness test battery over long tokens. Built-in functions only.

Battery, for each run of 20 or more characters of [A-Za-z0-9+/_-] (and padding, which is cut): its encoding is inferred (decimal, hex of
either case, base32, base36, base64), then three tests are made under the hypothesis "uniform over that alphabet": chi-squared
uniformity (as repeated-symbol pairs, whose mean and variance are exact for short strings too), Wald-Wolfowitz runs above
and below the alphabet's middle, and lag-1 serial correlation. A token is a secret if none of the three rejects it and if it is a
discovery against natural text: its p-value there passes Benjamini-Hochberg among all candidates of the corpus of its length band.
That p-value is the lesser of two, doubled: under text-like symbol repetition and character-class changes, and, for encodings of few
symbols, under text whose every letter or digit falls into the inferred alphabet by chance. p-values are counted in bins, rounded up, so the
control covers all documents with a bounded table of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked
from .quality import let

#: Fixed values of the contract: kinds in their order, patterns, group to measure, least length of it.
KINDS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),  # maximal runs: the same matches as dropping shorter ones afterwards
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = "[A-Za-z0-9+/_-]{20,}=*"
#: Natural text: share of equal pairs of symbols, share of neighbours of different character class, and factors on their variances.
PAIRS, CHANGES, SPREAD = 0.06, 0.12, 2.0
#: Natural text: share of its letters and digits that are digits, and that are 0-9 or a-f in either case (English letter frequencies).
SHARES = {10: 0.1, 16: 0.4}
BANDS = (20, 28, 40, 56, 80, 112, 160)
BINS_PER_DECADE, MAX_BIN = 20, 800
SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, kind, end) in code points of the pattern's leftmost non-overlapping matches whose group has least characters."""

    def placed(found: Column) -> Column:
        between, measured = F.split(text, pattern), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found)
        pieces = F.zip_with(F.zip_with(found, measured, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), F.slice(between, F.lit(1), F.size(found)), lambda x, gap: F.struct(F.length(gap).alias("gap"), x["m"].alias("m"), x["g"].alias("g")))
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["m"]).alias("at"),
            F.when(x["g"] >= least, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + x["gap"] + x["m"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPAN)))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, q).otherwise(1 - q)


DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def battery(token: Column) -> Column:
    """struct(random, natural): the least p-value of the three tests of uniformity (times three), and that under natural text."""
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    alphabet = lambda s: (
        F.when(s.rlike("^[0-9]+$"), DIGITS).when(s.rlike("^[0-9a-f]+$"), DIGITS + "abcdef").when(s.rlike("^[0-9A-F]+$"), DIGITS + "ABCDEF").when(s.rlike("^[A-Z2-7]+$"), UPPER + "234567").when(s.rlike("^[0-9a-z]*[0-9][0-9a-z]*$"), DIGITS + LOWER).otherwise(UPPER + LOWER + DIGITS + "+/")
    )
    kind = lambda ch: F.when(ch.between("0", "9"), 0).when(ch.between("A", "Z"), 1).when(ch.between("a", "z"), 2).otherwise(3)

    def tests(s: Column) -> Column:
        n, letters = F.length(s["s"]).cast("double"), F.filter(F.split(s["s"], ""), lambda c: c != "")
        size = F.length(s["a"]).cast("double")
        pairs = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc + let(n - F.length(F.replace(s["s"], c, F.lit(""))), lambda k: k * (k - 1) / 2))
        x = F.transform(letters, lambda c: F.instr(s["a"], c).cast("double") - 1)
        changes = lambda a, f: F.aggregate(F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda u, v: F.when(f(u) == f(v), 0.0).otherwise(1.0)), F.lit(0.0), lambda acc, v: acc + v)

        def figures(v: Column) -> Column:
            # v: n, size, pairs, x, mean, high, class changes
            all_pairs = v["n"] * (v["n"] - 1) / 2
            z_pairs = (v["pairs"] - all_pairs / v["size"]) / F.sqrt(all_pairs / v["size"] * (1 - 1 / v["size"]))
            low = v["n"] - v["high"]
            mean_runs = 2 * v["high"] * low / v["n"] + 1
            var_runs = (mean_runs - 1) * (mean_runs - 2) / (v["n"] - 1)
            z_runs = F.when(var_runs > 0, (v["runs"] - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(99.0))
            z_serial = F.when(v["square"] > 0, (v["product"] / v["square"] + 1 / v["n"]) * F.sqrt(v["n"])).otherwise(F.lit(99.0))
            uniform = F.least(F.lit(1.0), 3 * F.least(tail(z_pairs), 2 * tail(F.abs(z_runs)), 2 * tail(F.abs(z_serial))))
            few = (all_pairs * PAIRS - v["pairs"]) / F.sqrt(all_pairs * PAIRS * (1 - PAIRS) * SPREAD)
            many = (v["changes"] - (v["n"] - 1) * CHANGES) / F.sqrt((v["n"] - 1) * CHANGES * (1 - CHANGES) * SPREAD)
            inside = F.when(v["size"] == 10, F.pow(F.lit(SHARES[10]), v["n"])).when(v["size"] == 16, F.pow(F.lit(SHARES[16]), v["n"])).otherwise(F.lit(1.0))
            return F.struct(uniform.alias("random"), F.least(F.lit(1.0), 2 * F.least(inside, tail((few + many) / F.sqrt(F.lit(2.0))))).alias("natural"))

        def second(v: Column) -> Column:
            mean = v["sum"] / v["n"]
            square = F.aggregate(v["x"], F.lit(0.0), lambda acc, u: acc + (u - mean) * (u - mean))
            product = F.aggregate(F.zip_with(F.slice(v["x"], F.lit(1), F.size(v["x"]) - 1), F.slice(v["x"], F.lit(2), F.size(v["x"]) - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda acc, u: acc + u)
            runs = 1 + changes(v["x"], lambda u: u >= v["size"] / 2)
            high = F.aggregate(v["x"], F.lit(0.0), lambda acc, u: acc + F.when(u >= v["size"] / 2, 1.0).otherwise(0.0))
            return let(F.struct(v["n"].alias("n"), v["size"].alias("size"), v["pairs"].alias("pairs"), v["changes"].alias("changes"), square.alias("square"), product.alias("product"), runs.alias("runs"), high.alias("high")), figures)

        first = F.struct(n.alias("n"), size.alias("size"), pairs.alias("pairs"), x.alias("x"), F.aggregate(x, F.lit(0.0), lambda acc, u: acc + u).alias("sum"), changes(letters, kind).alias("changes"))
        return let(first, second)

    return let(plain, lambda s: let(F.struct(s.alias("s"), alphabet(s).alias("a")), lambda v: F.when(F.length(v["s"]) >= BANDS[0], tests(v)).otherwise(F.struct(F.lit(0.0).alias("random"), F.lit(1.0).alias("natural")))))


def band(length: Column) -> Column:
    return sum(((length >= x).cast("int") for x in BANDS[1:]), F.lit(0))


def p_bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_DECADE), F.lit(MAX_BIN)).cast("int")


def candidates(text: Column) -> Column:
    """Tokens for the battery: array<struct<start, kind, end, band, bin, random>>."""
    spans = matches(text, CANDIDATE, len(KINDS))
    rated = lambda s: let(battery(F.substring(text, s["start"] + 1, s["end"] - s["start"])), lambda b: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), band(s["end"] - s["start"]).alias("band"), p_bin(b["natural"]).alias("bin"), b["random"].alias("random")))
    return F.transform(spans, rated)


def thresholds(docs: DataFrame, rate: float) -> dict[int, int]:
    """Band to the least bin that is a discovery at this false-discovery rate; bands without one are left out."""
    found = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c")).groupBy("c.band", "c.bin").agg(F.count("*").alias("n")).collect()
    least: dict[int, int] = {}
    for b in {r["band"] for r in found}:
        counts = {r["bin"]: r["n"] for r in found if r["band"] == b}
        total, above = sum(counts.values()), 0
        for k in sorted(counts, reverse=True):
            above += counts[k]
            if 10 ** (-k / BINS_PER_DECADE) <= rate * above / total:
                least[b] = k
    return least


def secrets(docs: DataFrame, rate: float = 0.001, uniform_p: float = 0.001) -> DataFrame:
    """Adds to every row: n_assign, n_access, n_hex, base_spans, spans (arrays of start, kind, end, in order; end exclusive).

    kind is a position in KINDS, or len(KINDS) for a token the battery found outside all spans of the patterns. Offsets count
    code points. A null text counts as empty; an empty table gives no row; texts are scanned whole, whatever their length. Repeated
    rows each get the same values. Columns of docs that have a result's name are replaced.
    """
    least = thresholds(docs, rate)
    new = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]
    own = docs.drop(*new)
    text = F.col("text")
    step = docs.select(packed(own), F.coalesce("text", F.lit("")).alias("text"))
    step = step.select("row", *(matches(text, p, k, g, n).alias(f"s_{kind}") for k, (kind, (p, g, n)) in enumerate(KINDS.items())), candidates(text).alias("s_cand") if least else F.array().cast("array<struct<start:int,kind:int,end:int,band:int,bin:int,random:double>>").alias("s_cand"))
    base = F.sort_array(F.concat(*(F.col(f"s_{k}") for k in KINDS)))
    step = step.select("row", "s_cand", *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base_spans"))
    floor = F.create_map(*(F.lit(x) for kv in least.items() for x in kv)) if least else None
    free = lambda c: ~F.exists("base_spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    wanted = (lambda c: F.coalesce(c["bin"] >= floor[c["band"]], F.lit(False)) & (c["random"] >= uniform_p) & free(c)) if least else (lambda c: F.lit(False))
    added = F.transform(F.filter("s_cand", wanted), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return step.select(*unpacked(own), *(f"n_{k}" for k in KINDS), "base_spans", F.sort_array(F.concat("base_spans", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in [*KINDS, "random"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by one mask. spans: in order of start; they may overlap."""
    t = F.coalesce(text, F.lit(""))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
    )
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))).otherwise(text)
