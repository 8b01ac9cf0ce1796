"""The vector index against all pairs, on clusters, ties, odd rows and hot cells; stacking on held-out rows and where a class is missing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograph.operators import index, stacking
from stylograph.session import Stage


def vectors(rng, n=400, dims=12):
    centres = rng.normal(size=(8, dims))
    v = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * 0.3
    v[: n // 3] = centres[0] + rng.normal(size=(n // 3, dims)) * 0.01  # a third in one cell
    v[5] = v[6] = v[7]
    return v


def brute(v, queries, k):
    x = v / np.sqrt((v * v).sum(1, keepdims=True))
    s = x @ x.T
    out = {}
    for q in queries:
        order = sorted((j for j in range(len(v)) if j != q), key=lambda j: (-s[q, j], j))[:k]
        out[q] = [(j, s[q, j]) for j in order]
    return out


@pytest.mark.parametrize("kw", [{}, {"cells": 9, "tile": 16}])
def test_exact_search(spark, kw):
    v = vectors(np.random.default_rng(3))
    stage = Stage(spark, "t")
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [1.0, 2.0]), (1004, [])]
    f = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    built = index.build(f, stage, "id", "v", **kw)
    asked = f.filter("id % 9 = 0 or id > 999")
    got = {}
    for r in index.search(built, asked, stage, "id", "v", 7, probes=1, exact=True, same=True, query_tile=8).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["score"])
    want = brute(v, range(0, 400, 9), 7)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [found[k][1] for k in range(1, 8)] == pytest.approx([s for _, s in want[q]], abs=1e-9)
        assert sum(a == b for a, (b, _) in zip([found[k][0] for k in range(1, 8)], want[q], strict=True)) >= 5  # scores that differ in the last place may swap


def test_recall_grows_with_probes(spark):
    v = vectors(np.random.default_rng(4), 300)
    stage = Stage(spark, "t")
    f = stage.table(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), "v")
    built = index.build(f, stage, "id", "v", cells=12)
    true = stage.table(index.search(built, f, stage, "id", "v", exact=True, same=True), "all")
    probes = index.tuned(built, f, stage, "id", "v", same=True)
    found = stage.table(index.search(built, f, stage, "id", "v", probes=probes, same=True), "some")
    assert probes <= 12 and index.recall(found, true) >= 0.9 and true.count() == 3000
    none = f.filter("false")
    assert index.search(index.build(none, stage, "id", "v"), f, stage, "id", "v", exact=True).count() == 0 and index.search(built, none, stage, "id", "v").count() == 0


def test_attribution_by_a_scorer(spark):
    stage = Stage(spark, "t")
    profiles = spark.createDataFrame([("a", [1.0, 0.0, 0.1]), ("b", [0.9, 0.1, 0.0]), ("c", [0.0, 1.0, 0.0])], "author string, v array<double>")
    docs = spark.createDataFrame([(1, [1.0, 0.05, 0.05]), (2, [0.0, 1.0, 0.1]), (3, None)], "doc int, v array<double>")
    third = lambda d, p: F.get(p, F.lit(2))
    got = sorted(map(tuple, index.attribute(docs, profiles, stage, "doc", "v", "author", "v", third, k=2, exact=True).collect()))
    assert [(d, a, r) for d, a, _, r in got] == [("1", "a", 1), ("1", "b", 2), ("2", "b", 1), ("2", "c", 2)]


def test_cross_fitting(spark):
    """A feature that tells nothing of other rows gives no held-out skill, one that does gives much; labels never reach their own row."""
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.3).astype(int)
    good = np.clip(0.5 * y + rng.random(400) * 0.6, 0, 1)
    rows = [(k, int(t), float(g), float(u), "kept") for k, (t, g, u) in enumerate(zip(y, good, rng.random(400), strict=True))] + [(1000, None, 0.3, None, "no label"), (1001, 1, float("nan"), 0.2, "no score")]
    f = spark.createDataFrame(rows, "doc_id long, y int, p_ai_supervised double, noise double, fold_ string")
    for kind, least in (("linear", 0.8), ("tree", 0.75), ("heuristic", 0.8)):
        out = stacking.cross_fitted(f, ["p_ai_supervised", "noise"], Stage(spark, "t"), folds=2, kind=kind)
        assert out.count() == 402 and {r["kind"] for r in out.select("kind").distinct().collect()} == {kind} and out.filter("p is null or p < 0 or p > 1").count() == 0 or kind == "heuristic"
        assert stacking.held_out(out).first()["auroc"] > least, kind
    noise = stacking.cross_fitted(f, ["noise"], Stage(spark, "t"), folds=2, kind="linear")
    assert abs(stacking.held_out(noise).first()["auroc"] - 0.5) < 0.12


def test_a_missing_class(spark):
    f = spark.createDataFrame([(k, 1, k / 10) for k in range(10)], "doc_id long, y int, p_ai_supervised double")
    meta = stacking.fit(f, ["p_ai_supervised"])
    assert meta.kind == "heuristic" and [r["p"] for r in stacking.predict(f, meta).orderBy("doc_id").collect()] == pytest.approx([k / 10 for k in range(10)])
    assert {r["p"] for r in stacking.predict(f, stacking.fit(f, ["doc_id"])).collect()} == {0.5}
    assert stacking.fit(f.filter("false"), ["doc_id"]).kind == "heuristic"


def test_a_query_meets_a_unit_once(spark):
    """Cells that a query asks for leave its k best once a unit, not once a cell; tuning searches once; samples drop what is far above first."""
    v = vectors(np.random.default_rng(6), 600)
    stage = Stage(spark, "t")
    f = stage.table(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), "v")
    built = index.build(f, stage, "id", "v", cells=60, tile=100)
    asked = f.filter("id % 20 = 0")
    near = stage.table(asked.mapInArrow(index._probed(built, 60, False), "id long, v array<double>, asks array<struct<unit: int, cells: array<int>>>"), "near")
    held = [0] * (built.unit.max() + 1)
    for r in built.vectors.groupBy("cell").count().collect():
        held[built.unit[r["cell"]]] += r["count"]
    parts = sum(-(-n // 100) for n in held)
    assert near.selectExpr("explode(asks)").count() == 30 * sum(n > 0 for n in held) and parts < 30
    found = index._found(built, near, 3, True, 7)
    assert found.count() <= 30 * parts * 3 and found.groupBy("query").count().filter("count < 3").count() == 0
    fresh = Stage(spark, "t")
    index.tuned(built, asked, fresh, "id", "v", same=True)
    assert fresh._used["asked"] == 1
    for n in (5, 40, 600):
        assert [r["id"] for r in index.lowest(f, F.xxhash64("id"), "id", n, 600).collect()] == [r["id"] for r in f.orderBy(F.xxhash64("id"), "id").limit(n).collect()]


def test_tuning_counts_what_a_search_finds(spark):
    v = vectors(np.random.default_rng(7), 300)
    stage = Stage(spark, "t")
    f = stage.table(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), "v")
    built = index.build(f, stage, "id", "v", cells=30, tile=50)
    true = stage.table(index.search(built, f, stage, "id", "v", exact=True, same=True), "all")
    shares = {p: index.recall(index.search(built, f, stage, "id", "v", probes=p, same=True), true) for p in (1, 2, 4, 8, 16, 30)}
    for target in (0.5, 0.95):
        assert index.tuned(built, f, stage, "id", "v", target=target, same=True) == next(p for p, x in shares.items() if x >= target)
