"""Gates, thresholds, metrics, duplicates, splits and plugins on small cases."""

import pytest
from pyspark.sql import functions as F

from stylograph.operators import corpus, ensemble, metrics
from stylograph.plans import plugins
from stylograph.session import Stage
from stylograph.sources import files


def verdict(spark, probs, votes, agree, profile):
    return spark.createDataFrame([(probs,)], "p array<double>").select(ensemble.gates(F.col("p"), F.lit(votes), F.lit(agree), profile).alias("g")).collect()[0]["g"]


def test_gates(spark):
    p = [0.1, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert verdict(spark, p, 2 / 3, 1.0, "moderate")["verdict"] == "INCONCLUSIVE"
    assert verdict(spark, p, 1 / 3, 1.0, "permissive")["verdict"] == "AI_DETECTED"
    assert verdict(spark, p, 1.0, 1.0, "strict")["safe_for_action"]
    assert verdict(spark, [0.5, 0.2, 0.1, 0.1, 0.05, 0.05, 0.0], 1 / 3, 0.0, "permissive")["verdict"] == "AI_DETECTED"
    assert verdict(spark, [0.9, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0], 0.0, 0.0, "strict")["verdict"] == "HUMAN"


def test_conformal(spark):
    d = spark.createDataFrame([(k / 100, 0) for k in range(1, 101)], "p double, y int")
    r = ensemble.conformal(d, 0.01).collect()
    assert [(x["n"], x["tau_ai"], round(x["tau_human"], 3)) for x in r] == [(100, 1.0, 0.505)]
    assert [(x["tau_ai"], x["tau_human"]) for x in ensemble.conformal(d.filter("y = 1"), 0.01).collect()] == [(1.01, 0.49)]


def test_document_verdict(spark):
    d = spark.createDataFrame([(1, "AI_DETECTED", "GPT")] * 8 + [(1, "HUMAN", None)] * 2 + [(2, "HUMAN", None)], "doc_id long, verdict string, ai_model string")
    r = {x["doc_id"]: x for x in ensemble.document_verdict(d).collect()}
    assert (r[1]["ai_ratio"], r[1]["confidence"], r[1]["dominant_ai_model"]) == (0.8, "moderate", "GPT")
    assert r[2]["confidence"] == "insufficient_data"


def test_metrics_edges(spark):
    tie = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.auroc(tie).collect()[0]["auroc"] == 0.5
    assert metrics.auroc(tie.filter("y = 0")).collect()[0]["auroc"] is None
    none = tie.withColumn("pred", F.lit(0))
    assert metrics.confusion(none).collect()[0]["mcc"] == 0.0


def test_temperature(spark):
    logits = spark.createDataFrame([(k, [4.0, 0.0] if k % 10 else [0.0, 4.0], 0) for k in range(200)], "doc_id long, logits array<double>, label int")
    t = ensemble.fit_temperature(logits.select("doc_id", "logits"), logits.select("doc_id", "label"))
    assert abs(t - 4 / 2.1972) < 0.02  # the odds 9 : 1 at that temperature


def test_near_duplicates_match_a_greedy_pass(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day "
    rows = [(k, base * 3 + ("" if k % 3 else f"x{k}")) for k in range(12)] + [(50, "another text altogether, with its own words"), (51, " "), (52, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    signed = {r["doc_id"]: r["keys"] for r in corpus.minhash(d.filter("trim(text) <> ''")).select("doc_id", corpus.band_keys(F.col("sig")).alias("keys")).collect()}
    seen, want = set(), []
    for k in sorted(signed):
        if not seen & set(signed[k]):
            want.append(k)
            seen |= set(signed[k])
    got = sorted(r["doc_id"] for r in corpus.drop_near_duplicates(d, Stage(spark, "near")).collect())
    assert got == want
    assert sorted(r["doc_id"] for r in corpus.drop_near_duplicates(d.repartition(7), Stage(spark, "near")).collect()) == want


def test_split_has_no_leak(spark):
    d = spark.range(1000).withColumn("g", (F.col("id") % 100).cast("string"))
    s = corpus.split_groups(d, F.col("g"))
    assert s.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()} == {"train": 80, "val": 10, "test": 10}


def test_labels(spark):
    d = spark.createDataFrame([("a", "OpenAI"), ("b", "llama"), (" ", "human")], "text string, target_model string")
    assert [tuple(r) for r in corpus.label_rows(d).select("text", "label").collect()] == [("a", "GPT")]
    with pytest.raises(ValueError):
        corpus.label_rows(d.select("text"))


def test_dictionary_top(spark):
    d = spark.createDataFrame([(1, "a b " * 12 + "c d e f g h")], "doc_id long, text string")
    top = corpus.ngram_dictionary(d, top=2, orders=(2,)).orderBy(F.desc("cnt")).collect()
    assert [(r["ngram"], r["cnt"]) for r in top] == [("a b", 12), ("b a", 11)]


def test_attacks_are_undone(spark):
    from stylograph.functions import columns as C

    d = spark.createDataFrame([(1, "a plain text of some xylophone copy, for once")], "doc_id long, text string")
    for kind in ("homoglyph", "zero_width", "whitespace"):
        a = corpus.attack(F.col("text"), F.col("doc_id"), kind, 0.9)
        r = d.select(a.alias("a"), C.canonical(a).alias("c"), "text").collect()[0]
        assert r["a"] != r["text"] and r["c"] == r["text"], kind


def test_plugin_order():
    p = lambda n, *r: plugins.Plugin(n, lambda df: df, r)
    assert [x.name for x in plugins.order([p("c", "a"), p("b"), p("a")])] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        plugins.order([p("a", "b"), p("b", "a")])
    with pytest.raises(ValueError):
        plugins.order([p("a", "missing")])


def test_plugin_errors(spark):
    def bad(df):
        raise RuntimeError("no")

    out, errors = plugins.run(spark.range(2), [plugins.Plugin("x", bad), plugins.Plugin("y", lambda df: df, ("x",)), plugins.Plugin("z", lambda df: df.withColumn("z", F.lit(1)))])
    assert out.columns == ["id", "z"] and set(errors) == {"x", "y"}


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("word " * 25)
    (tmp_path / "t/b.txt").write_text("short")
    assert files.dictionary_texts(spark, str(tmp_path / "t"), "folder").count() == 1
    (tmp_path / "x.jsonl").write_text('{"text": ["' + "w " * 20 + '", "no"]}\n')
    assert files.dictionary_texts(spark, str(tmp_path / "x.jsonl"), "jsonl").count() == 1
    made = files.cached(spark, str(tmp_path / "c"), lambda: spark.range(3))
    assert made.count() == 3 and files.cached(spark, str(tmp_path / "c"), lambda: 1 / 0).count() == 3
    assert files.same_files(spark, str(tmp_path / "t"), str(tmp_path / "t")) and not files.same_files(spark, str(tmp_path / "t"), str(tmp_path / "c"))
