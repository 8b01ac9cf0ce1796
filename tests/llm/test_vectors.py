"""Metric range join, vector codes and filter audit against brute force and their SQL, on hot, tied, null and repeated rows."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from stylograph.llm import audit, codebooks, metric
from stylograph.llm.common import Scratch, forest

VECTORS = "vec_id long, embedding array<float>, label int, node string, cell string, v string, code int, error string"


def rows(dims=16, seed=5):
    """Random vectors, a dense group, a loose one (cosines around the threshold), copies, scaled ones, and those without a direction."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dims) for _ in range(150)]
    base = rng.normal(size=dims)
    out += [base + rng.normal(size=dims) * 0.02 for _ in range(120)]
    loose = rng.normal(size=dims)
    out += [loose + rng.normal(size=dims) * 0.25 for _ in range(120)]
    out += [out[3]] * 40 + [out[4] * 3.0, out[4] * 1e-30, out[5] * 1e30, -out[6]]
    out = [[float(np.float32(x)) for x in v] for v in out]
    out += [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] + [1.0] * (dims - 1), [-0.0] * dims]
    out += [v[:5] for v in out[:3]] + [out[0][:5]]  # of another length
    ids = list(range(len(out)))
    random.Random(1).shuffle(ids)
    return list(zip(ids, out, strict=True))


def brute_links(vectors, threshold):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, np.float64) / max(map(abs, v))
        return a / math.sqrt((a * a).sum())

    units = [unit(v) for _, v in vectors]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(units)), 2) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold]
    return pairs


@pytest.mark.parametrize("kw", [{}, {"pivots": 9}, {"pivots": 9, "tile": 16, "local_edges": 3}, {"pivots": 400, "tile": 16}])
@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_metric_join(spark, monkeypatch, kw, threshold):
    if "tile" in kw:
        monkeypatch.setattr(metric, "LEAST", 4)
        monkeypatch.setattr(metric, "BLOCK", 64)
    vectors = rows()
    pairs = brute_links(vectors, threshold)
    up = forest((min(vectors[i][0], vectors[j][0]), max(vectors[i][0], vectors[j][0])) for i, j in pairs)
    want = {d: (sum(vectors[i][0] == d or vectors[j][0] == d for i, j in pairs), up.get(d, d)) for d, _ in vectors}
    df = spark.createDataFrame([(d, v, None, "x", "y", "z", 1, "e") for d, v in vectors], VECTORS).repartition(5)
    got = metric.near_vectors(df, Scratch(spark, "t"), threshold=threshold, **kw).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(vectors)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert max(n for n, _ in want.values()) >= 100


def test_metric_join_discards_cells():
    """Clustered vectors are sent to few cells, and none that links is left out."""
    rng = np.random.default_rng(2)
    centres = metric.unit(rng.normal(size=(30, 32)))
    x = metric.unit(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 32)) * 0.02)
    pivots = metric.spread(x, 30)
    assert len(metric.spread(np.ones((5, 3)) / math.sqrt(3), 4)) == 1
    r = math.acos(0.95)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x.tolist()), pa.array([1] * len(x))], names=["node", "v", "copies"])
    home = next(metric._cells(pivots, r)([batch]))
    cell, angle = home.column("cell").to_numpy(), home.column("angle").to_numpy()
    reach = np.array([angle[cell == c].max() if (cell == c).any() else -1 for c in range(60)])
    to = next(metric._targets(pivots, r, reach)([batch])).column("to").to_pylist()
    assert sum(map(len, to)) < len(x)


def test_metric_join_ids(spark):
    """Null and repeated ids, and an empty table."""
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    given = [(None, near), (7, near), (5, [1.0, 0.0, 0.12]), (None, far), (9, [0.0, 0.0, 1.0]), (9, far), (9, far)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    got = sorted(metric.near_vectors(df, Scratch(spark, "t")).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(None, 2, 5, False), (7, 2, 5, False), (5, 2, 5, True), (None, 2, 9, False), (9, 0, 9, True), (9, 2, 9, True), (9, 2, 9, True)], key=lambda x: str(got[0].__class__(vec_id=x[0], n_links=x[1], component_id=x[2], kept=x[3])))
    assert metric.near_vectors(df.filter("false"), Scratch(spark, "t")).count() == 0
    alone = metric.near_vectors(df.filter("vec_id is null and embedding[1] = 1"), Scratch(spark, "t")).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in alone] == [(0, None, True)]


def brute_codes(vectors, parts, entries, rounds):
    """The contract, entry by entry."""
    kept = [(d, [math.floor(x * 4096) for x in v], lab) for d, v, lab in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: x[0])
    m = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * m : (p + 1) * m]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        took = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p in range(parts):
                took[p][best(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else e for e, xs in zip(b, t, strict=True)] for b, t in zip(books, took, strict=True)]
    out = {d: ("".join(f"{best(v, p)[1]:02x}" for p in range(parts)), sum(best(v, p)[0] for p in range(parts)), lab) for d, v, lab in kept}
    by = {lab: sum(e for _, e, x in out.values() if x == lab) for lab in {x for _, _, x in out.values()}}
    return {d: (c, e, by[lab]) for d, (c, e, lab) in out.items()}, books


def coded(spark, given, **kw):
    df = spark.createDataFrame([(d, v, lab, "x", "y", "z", 1, "e") for d, v, lab in given], VECTORS).repartition(4)
    found, books = codebooks.compress(df, Scratch(spark, "t"), **kw)
    return [(r["id"], (r["code"], r["error"], r["label_error"])) for r in found.collect()], books


@pytest.mark.parametrize("kw", [{}, {"parts": 2, "entries": 5, "rounds": 3}])
def test_codes(spark, kw):
    given = [(d, v, None if k % 5 == 0 else k % 3) for k, (d, v) in enumerate(rows()) if not v or len(v) == 16 and max(abs(x or 0) for x in v) < 1e4 or not all(x is not None and math.isfinite(x) for x in v)]
    want, books = brute_codes(given, **{"parts": 8, "entries": 16, "rounds": 6, **kw})
    got, ours = coded(spark, given, **kw)
    assert dict(got) == want and len(got) == len(want)
    assert [b.tolist() for b in ours] == books
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(x) for x in given])
    theirs = con.execute(codebooks.sql(**kw)).fetchall()
    assert {r[0]: tuple(r[1:4]) for r in theirs} == want and {r[4] for r in theirs} == {codebooks.digest(ours)}


def test_codes_of_ties(spark):
    """Small integers: many entries at equal distances, equal entries, parts of equal vectors; the lowest index wins."""
    rng = np.random.default_rng(4)
    for k in range(30):
        entries = rng.integers(-2, 3, (rng.integers(1, 40), 3))
        x = rng.integers(-3, 4, (200, 3))
        at, best = codebooks.nearest(codebooks.tree(entries), x)
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all(), k
    given = [(k, [float(k % 2) / 4096, 0.0], None) for k in range(20)]
    assert dict(coded(spark, given, parts=2)[0]) == brute_codes(given, 2, 16, 6)[0]


def test_codes_of_odd_rows(spark):
    """An empty table, fewer rows than entries, other lengths, values out of range, null and repeated ids."""
    assert coded(spark, [(1, None, 2)])[0] == [] and coded(spark, [(1, [], 2)])[1] == []
    given = [(3, [0.5, 0.25], 1), (None, [0.5, 0.5], None), (3, [0.5, 0.25], 1), (8, [1.0], 1), (9, [1e9, 0.0], 1)]
    got, books = coded(spark, given, parts=2)
    assert sorted(got, key=str) == [(3, ("0000", 0, 0)), (3, ("0000", 0, 0)), (None, ("0002", 0, 0))] and len(books[0]) == 3


DOCS = [
    (1, "word " * 60, "web"), (2, "word " * 60, "web"), (2, "word " * 60, None), (3, " ".join(f"w{k}" for k in range(70)), "web"), (4, " ".join(f"W{k}" for k in range(70)), "hot"),
    (5, "pay $5", "hot"), (6, None, "hot"), (7, "", None), (None, "", "hot"), (None, "pay $5", ""), (8, "É Ü " + "a\x0bb\tc\n" * 2000 + "|", "hot"), (9, " \t\n", "x"), (10, "ABC", "x"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (4, None, 1), (None, 1, 1), (77, 1, 1), (6, 1, None)]


def brute_audit():
    fails = []
    for k, (d, text, source) in enumerate(DOCS):
        t = text or ""
        w = [x for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        bad = {f for f, on in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)), ("D", any(c in "#$%&*|" for c in t))) if on}
        if any(d is not None and e is not None and e < d and (u or "") == t for e, u, _ in DOCS):
            bad.add("E")
        good, toxic = (any(x[0] == d and x[0] is not None and x[i] == 1 for x in LABELS) for i in (1, 2))
        fails.append((source or "", bad, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                here = [x for x in own if f in x[1] and not x[1] & before]
                out[part, order, s + 1] = [sum(not x[1] & {*before, f} for x in own), len(here), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
                removed[f] = removed.get(f, 0) + len(here)
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                out[part, order, s + 1].append(removed[f])
    return out


def test_audit(spark):
    docs = spark.createDataFrame([(*x, "p", 1, "m") for x in DOCS], "doc_id long, text string, source string, part string, mask int, digest string")
    labels = spark.createDataFrame([(*x, "t") for x in LABELS], "doc_id long, quality int, toxic int, text string")
    got = audit.audit(docs, labels, Scratch(spark, "t")).collect()
    want = brute_audit()
    assert len(got) == len(want) == 600 * 4
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want
    assert audit.audit(docs.filter("false"), labels, Scratch(spark, "t")).count() == 0
    assert audit.audit(docs, labels.filter("false"), Scratch(spark, "t")).filter("good_lost + toxic_lost > 0").count() == 0


def test_audit_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [list(x) for x in DOCS])
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", [list(x) for x in LABELS])
    found = con.execute(audit.sql())
    names = [x[0] for x in found.description]
    assert names == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {r[:3]: list(r[3:]) for r in found.fetchall()} == brute_audit()


def test_more_parts_than_are_made_at_once(spark, monkeypatch):
    monkeypatch.setattr(audit, "AT_ONCE", 2)
    counts = spark.createDataFrame([(f"p{k}", m, k + m, k, m) for k in range(7) for m in (0, 1, 3)], "part string, mask int, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.outcomes(counts, "AB").collect()}
    assert len(got) == 7 * 2 * 2
    one = got["p5", "BA", 2]
    assert (one["kept"], one["removed"], one["redundant"], one["unique_fails"], one["good_lost"], one["toxic_lost"], one["shapley"]) == (5, 6, 8, 6, 5, 1, 2 * 6 + 8)
