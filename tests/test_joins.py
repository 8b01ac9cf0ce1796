"""As-of and interval joins, selection, streams, the bounded dictionary, row errors, records and chunks against plain Python, on hot, tied and null rows."""

import json
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylograph.operators import catalogue, chunks, ensemble, metrics, selection, temporal
from stylograph.plans import plugins, rows
from stylograph.session import Stage
from stylograph.sources import files
from stylograph.streaming import dictionary
from stylograph.streaming import events as E

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def event_rows(rng, n, hot=True):
    """A hot user with a third of the rows and many equal times, null users and times."""
    out = []
    for k in range(n):
        user = 1 if hot and k % 3 == 0 else rng.choice([*range(2, 9), None])
        out.append((k, user, None if rng.random() < 0.03 else at(rng.randrange(0, 400)), float(k)))
    return out


EVENTS = "event_id long, user_id long, ts timestamp, value double"


@pytest.mark.parametrize("tolerance", [None, 30])
@pytest.mark.parametrize("partitions", [1, 12])
def test_as_of(spark, tolerance, partitions):
    rng = random.Random(partitions)
    left, right = event_rows(rng, 600), event_rows(rng, 90)
    left += left[:30]  # repeated rows
    a, b = spark.createDataFrame(left, EVENTS), spark.createDataFrame(right, EVENTS)
    got = temporal.as_of(a, b, "user_id", "ts", Stage(spark, "t"), f"{tolerance} seconds" if tolerance else None, partitions, tie="event_id").select("event_id", "right.event_id").toDF("l", "r").collect()

    def want(user, ts):
        of = [(t, k) for k, u, t, _ in right if u == user and t is not None and u is not None and ts is not None and t <= ts]
        best = max(of, default=None)
        return best[1] if best and (tolerance is None or best[0] >= ts - timedelta(seconds=tolerance)) else None

    assert sorted(map(tuple, got), key=str) == sorted(((k, want(u, t)) for k, u, t, _ in left), key=str)


def test_as_of_empty(spark):
    a = spark.createDataFrame(event_rows(random.Random(1), 9), EVENTS)
    assert temporal.as_of(a, a.filter("false"), "user_id", "ts", Stage(spark, "t")).filter("right is null").count() == 9
    assert temporal.as_of(a.filter("false"), a, "user_id", "ts", Stage(spark, "t")).count() == 0


@pytest.mark.parametrize("width,most", [(7.0, 5), (1000.0, 20), (50.0, 100_000)])
def test_within(spark, width, most):
    rng = random.Random(3)
    points = event_rows(rng, 300)
    spans = [(k, u, t, t + timedelta(seconds=rng.choice([0, 5, 120])) if t and rng.random() > 0.1 else None) for k, u, t, _ in event_rows(rng, 80)]
    p, s = spark.createDataFrame(points, EVENTS), spark.createDataFrame(spans, "span_id long, user_id long, ts timestamp, until timestamp")
    got = temporal.within(p, s, "user_id", "ts", "ts", "until", Stage(spark, "t"), width, most).select("point.event_id", "interval.span_id").collect()
    want = [(k, i) for k, u, t, _ in points for i, v, a, b in spans if u is not None and u == v and t and a and b and a <= t < b]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


VALUES = {
    "ties": [1.0] * 500 + [2.0] * 3,
    "one": [5.5],
    "wide": [-1e308, 1e308, 0.0, 1e-300, 5e-324, -5e-324] * 3,
    "close": [1.0 + k * 2.0**-52 for k in range(40)],
    "even": [float(k) for k in range(1, 101)],
    None: [float("nan"), None, 3.0, -2.0],
    "none": [None, float("nan")],
}


@pytest.mark.parametrize("cells", [3, 4096])
def test_selection(spark, cells):
    f = spark.createDataFrame([(g, v) for g, vs in VALUES.items() for v in vs], "g string, v double")
    got = {}
    for r in selection.ranked(f, F.array(F.lit(0), F.lit(1), F.lit(2), F.ceil(F.col("n") / 2), F.col("n"), F.col("n") + 1), Stage(spark, "t"), cells).collect():
        got.setdefault(r["g"], {})[r["rank"]] = r["value"]
    for g, vs in VALUES.items():
        s = sorted(v for v in vs if v is not None and not math.isnan(v))
        assert got.get(g, {}) == {k: s[k - 1] for k in {1, 2, math.ceil(len(s) / 2), len(s)} if 1 <= k <= len(s)}, g


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=500), np.repeat(0.25, 100)])
    f = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {r["share"]: r["value"] for r in selection.quantiles(f, shares, Stage(spark, "t"), 8).collect()}
    assert got == pytest.approx({p: float(np.quantile(v, p)) for p in shares})


def test_thresholds_of_large_groups(spark):
    """Ranks as they are defined, with and without groups; no negatives."""
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(700)]
    s = spark.createDataFrame(data, "lang string, y int, p double")
    got = {r["grp"]: r for r in ensemble.conformal(s, 0.05, "lang", 50).collect()}
    for g in ("a", "b", None):
        h = sorted(p for x, y, p in data if y == 0 and (g is None or x == g))
        k = min(len(h), max(1, math.ceil((len(h) + 1) * 0.95 - 1e-9)))
        assert (got[g]["n"], got[g]["tau_ai"], got[g]["tau_human"]) == (len(h), h[k - 1], pytest.approx(np.median(h)))
    none = ensemble.conformal(s.filter("y = 1")).collect()
    assert [(r["n"], r["tau_ai"]) for r in none] == [(0, 1.01)]
    assert metrics.tpr_at_fpr(s, 0.05).first()["tau"] == pytest.approx(np.quantile([p for _, y, p in data if y == 0], 0.95))
    assert metrics.tpr_at_fpr(s.filter("y = 1")).first()["tau"] is None


# streams
def stream(spark, path, batches, schema, build):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return build(E.read(spark, f"{path}/in", spark.createDataFrame([], schema).schema))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    e = lambda k, s, user=1: (k, at(s), user, "x", 1.0)
    batches = [[e(1, 0), e(1, 5), e(2, 600), e(9, 650, None)], [e(3, 7200)], [e(7, 7250)], [e(4, 60), e(5, 7100)], [e(6, 20_000)]]

    def result(name, build):
        path = f"{tmp_path}/{name}"
        E.write(stream(spark, path, batches, schema, build), f"{path}/out", f"{path}/mark").awaitTermination()
        return spark.read.parquet(f"{path}/out")

    slid = result("slide", lambda s: E.sliding(s, "1 hour", "1 hour"))
    # event 4 is 2 hours late and gone, 5 is within its 10 minutes
    assert sorted((r["start"], r["n"]) for r in slid.collect()) == [(at(0), 4), (at(3600), 1), (at(7200), 2)]
    runs = result("sessions", E.sessions)
    assert sorted((r["start"], r["end"], r["n"]) for r in runs.collect()) == [(at(0), at(600 + 1800), 3), (at(7100), at(7250 + 1800), 3)]
    assert sorted(r["event_id"] for r in result("first", E.first_seen).collect()) == [1, 2, 3, 5, 6, 7, 9]


def texts(rng, n):
    return [(" ".join(rng.choice("abcdefghij") * rng.choice([1, 1, 1, 2]) for _ in range(30)),) for _ in range(n)]


@pytest.mark.parametrize("keep", [10_000, 25])
def test_bounded_dictionary(spark, tmp_path, keep):
    rng = random.Random(5)
    batches = [texts(rng, 40) for _ in range(5)]
    where = [f"{tmp_path}/{x}" for x in ("in", "table", "mark")]
    source = lambda: E.read(spark, where[0], T.StructType([T.StructField("text", T.StringType())]))
    for k, b in enumerate(batches):  # a restart after every batch
        spark.createDataFrame(b, "text string").coalesce(1).write.mode("append").parquet(where[0])
        dictionary.start(source(), where[1], where[2], keep=keep, orders=(2, 3)).awaitTermination()
        if k == 2:  # a batch that failed half-way is tried again: its table is there without a mark of success
            assert dictionary._versions(spark, where[1]) == [1, 2]
    true = Counter((n, " ".join(w[i : i + n])) for b in batches for (t,) in b for w in [t.split()] for n in (2, 3) for i in range(len(w) - n + 1))
    got = {(r["n"], r["ngram"]): (r["cnt"], r["err"]) for r in dictionary.current(spark, where[1]).collect()}
    floor = {r["n"]: r["floor"] for r in dictionary.floors(spark, where[1]).collect()}
    assert all(c <= true[k] <= c + e for k, (c, e) in got.items())
    assert all(true[k] <= floor[k[0]] for k in true if k not in got)
    if keep == 10_000:
        assert got == {k: (c, 0) for k, c in true.items()}
    else:
        assert all(sum(k[0] == n for k in got) <= keep for n in (2, 3)) and max(floor.values()) > 0 and len(got) > 5


def test_dictionary_batch_tried_again(spark, tmp_path):
    """The same batch twice, as after a crash between its table and the stream's mark, counts once."""
    before = spark.createDataFrame([(2, "a b", 5, 0), (2, None, 0, 3)], dictionary.SCHEMA)
    counts = spark.createDataFrame([(2, "a b", 2), (2, "c d", 1), (3, "a b c", 1)], "n int, ngram string, cnt bigint")
    once = dictionary.merged(before, counts, 100, lambda df: df)
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(2, "a b", 7, 0), (2, "c d", 1, 3), (3, "a b c", 1, 0), (2, None, 0, 3), (3, None, 0, 0)], key=str)
    pruned = dictionary.merged(before, counts, 1, lambda df: df)
    assert sorted(map(tuple, pruned.collect()), key=str) == sorted([(2, "a b", 7, 0), (3, "a b c", 1, 0), (2, None, 0, 4), (3, None, 0, 0)], key=str)


# row errors
def test_row_errors(spark):
    f = spark.createDataFrame([(1, "12"), (2, "x"), (3, None), (4, "0")], "id int, text string")
    number = rows.RowPlugin("number", lambda r: r["text"].cast("int"), refuse=lambda r: F.when(~r["text"].rlike("^[0-9]+$") | r["text"].isNull(), "no number"))
    inverse = rows.RowPlugin("inverse", lambda r: F.lit(12) / r["number"], ("number",), refuse=lambda r: F.when(r["number"] == 0, "zero"))

    def halved(row, state):
        return {"half": row["inverse"] / state["by"]}

    def broken():
        raise RuntimeError("no model")

    double = T.StructType([T.StructField("half", T.DoubleType())])
    raw = T.StructType([T.StructField("raw_result", T.StringType())])
    steps = [
        inverse, number, rows.PythonPlugin("half", halved, double, requires=("inverse",), warm_up=lambda: {"by": 2}), rows.PythonPlugin("cold", lambda r, s: {}, double, warm_up=broken),
        rows.PythonPlugin("bare", lambda r, s: r["text"][0], raw), rows.RowPlugin("after", lambda r: r["half"]["half"] + 1, ("half",)), rows.RowPlugin("other", lambda r: r["id"] * 2),
        rows.RowPlugin("absent", lambda r: F.lit(1), available=lambda: False), rows.RowPlugin("needs", lambda r: r["absent"], ("absent",)),
    ]
    got = {r["id"]: r for r in rows.run(f, steps).collect()}
    cold, needs = {"cold": "RuntimeError: no model"}, {"needs": "skipped: requires absent"}
    assert got[1]["errors"] == {**cold, **needs} and got[1]["half"]["half"] == 0.5 and got[1]["after"] == 1.5 and got[1]["bare"]["raw_result"] == "1"
    skipped = {"number": "no number", "inverse": "skipped: requires number", "half": "skipped: requires inverse", "after": "skipped: requires half", **cold, **needs}
    assert got[2]["errors"] == skipped and got[2]["bare"]["raw_result"] == "x"
    assert got[3]["errors"] == {**skipped, "bare": "TypeError: 'NoneType' object is not subscriptable"}
    assert got[4]["errors"] == {"inverse": "zero", "half": "skipped: requires inverse", "after": "skipped: requires half", **cold, **needs}
    assert [got[k]["other"] for k in (1, 2, 3, 4)] == [2, 4, 6, 8] and all(r["absent"] is None for r in got.values())
    assert rows.run(f.filter("false"), steps).count() == 0 and rows.run(f, []).first()["errors"] == {}


def test_config(spark):
    config = plugins.Config(references=True, watermark=True, stylometric=False)
    assert config.names() == ["reasoning", "hallucination", "perplexity", "references", "watermark"] and len(vars(config)) == 13
    text = "One two three four five. " * 20 + "\nReferences\nDoe, A. (2001). A title of a work.\n"
    f = spark.createDataFrame([(1, text, list(range(40)), [2.0, 4.0]), (2, None, None, None)], "doc_id long, text string, token_ids array<int>, token_ppl array<double>")
    out, errors = plugins.run(f, plugins.standard(config))
    one, none = (out.filter(f"doc_id = {k}").first() for k in (1, 2))
    assert not errors and one["references"]["total_references"] == 1 and one["tier"] == "tier2" and one["perplexity"]["proxy_perplexity_mean"] == 3.0
    assert none["tier"] == "tier1" and none["watermark"]["z"] == 0.0 and 0 <= one["perplexity_risk"] <= 1


# records and chunks
def test_records(spark):
    cases = [
        ("crossref", {"title": ["A", "B"], "author": [{"family": "Doe"}, {"given": "x"}, {"family": ""}], "published-online": {"date-parts": [[2003, 1]]}, "created": {"date-parts": [[1999]]}, "container-title": ["J"], "DOI": "10.1/a"}, ("A", ["doe"], 2003, "J", "10.1/a")),
        ("crossref", {"title": "Plain", "container-title": "K", "published-print": {"date-parts": [[None]]}}, ("Plain", [], None, "K", "")),
        ("crossref", {"title": [], "author": "nobody", "created": {"date-parts": [["2011"]]}}, ("", [], 2011, "", "")),
        ("openalex", {"display_name": "", "title": "T", "authorships": [{"author": {"display_name": "Ann  van Dyk "}}, {}], "publication_year": 2020, "primary_location": None, "doi": "https://doi.org/10.2/b"}, ("T", ["dyk"], 2020, "", "10.2/b")),
        ("openalex", {"display_name": "D", "primary_location": {"source": {"display_name": "S"}}, "doi": None}, ("D", [], None, "S", "")),
        ("semantic_scholar", {"title": "S", "authors": [{"name": "J. Roe"}], "year": 2001, "venue": "V", "externalIds": {"DOI": "10.3/c"}}, ("S", ["roe"], 2001, "V", "10.3/c")),
        ("semantic_scholar", {"title": None, "authors": None, "year": None, "externalIds": None}, ("", [], None, "", "")),
    ]
    given = [(k, s, json.dumps(x)) for k, (s, x, _) in enumerate(cases)] + [(100, "crossref", '{"title": ["A"'), (101, "crossref", None), (102, "crossref", "[1]"), (103, "other", "{}"), (104, "openalex", '"text"')]
    got = {r["k"]: r["m"] for r in spark.createDataFrame(given, "k int, shape string, j string").select("k", catalogue.meta(F.col("j"), F.col("shape")).alias("m")).collect()}
    assert {k: tuple(v) for k, v in got.items() if v is not None} == {k: m for k, (_, _, m) in enumerate(cases)}


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (4, 1), (1024, 64)])
def test_chunks(spark, size, overlap):
    step = size - overlap
    lengths = [*range(0, 45), 1024, 1985, 2000]
    f = spark.createDataFrame([(n, list(range(n))) for n in lengths] + [(-1, None)], "id int, t array<int>")
    cut = chunks.explode_chunks(f, "id", "t", size, overlap)
    got = {}
    for r in cut.collect():
        got.setdefault(r["id"], {})[r["chunk"]] = (r["start"], r["tokens"])
    for n in lengths:
        want, start = [], 0
        while start < n:
            want.append((start, list(range(n))[start : start + size]))
            start += step
            if len(want[-1][1]) < size:
                break
        assert [got.get(n, {})[k] for k in range(len(got.get(n, {})))] == want, n
    whole = chunks.stitched(cut.withColumn("values", F.transform("tokens", lambda x: x * 2)), "id", overlap=overlap)
    assert {r["id"]: r["values"] for r in whole.collect()} == {n: [2 * x for x in range(n)] for n in lengths if n}


def test_verified_copies(spark, tmp_path):
    """A missing and a damaged file are found and mended, also one of the right size; what is right is kept."""
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "sub dir").mkdir(parents=True)
    rng = random.Random(1)
    for k, name in enumerate(("x.bin", "y.bin", "sub dir/z.bin", "empty")):
        (a / name).write_bytes(rng.randbytes(0 if name == "empty" else 40_000 + k))
    copy = lambda **kw: {r["name"]: r["status"] for r in files.copy_verified(spark, f"file://{a}", f"file://{b}", Stage(spark, "t"), **kw).collect()}
    assert set(copy().values()) == {"copied"} and set(copy().values()) == {"kept"}
    (b / "y.bin").write_bytes(bytes(40_001))
    (b / "sub dir/z.bin").unlink()
    assert copy(by_size=True) == {"x.bin": "kept", "y.bin": "kept", "sub dir/z.bin": "copied"}
    assert copy() == {"x.bin": "kept", "y.bin": "mended", "sub dir/z.bin": "kept"}
    assert all((a / n).read_bytes() == (b / n).read_bytes() for n in ("x.bin", "y.bin", "sub dir/z.bin")) and not list(b.rglob("*.part"))


def test_green_counts():
    """The counts of the query's function against the list itself."""
    from stylograph.operators import watermark

    g = watermark.green(3, 1000, 0.5)
    assert g.sum() == 500 and g.dtype == bool and (g == watermark.green(3, 1000, 0.5)).all() and (g != watermark.green(4, 1000, 0.5)).any()
