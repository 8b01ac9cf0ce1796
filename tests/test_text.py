"""Hand-checked cases of text functions and features."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograph.functions import columns as C
from stylograph.operators import citations, features, report, style, watermark


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<double>'}" for k, v in values.items()))
    return row.select(column.alias("x")).collect()[0]["x"]


def test_homoglyph(spark):
    t = one(spark, C.tamper(F.col("t")), t="pаper")
    assert (t["replaced"], round(t["ratio"], 4), t["suspicious"]) == (1, 0.1667, True)
    assert one(spark, C.canonical(F.col("t")), t="pаper") == "paper"


def test_zero_width_and_hyphen(spark):
    assert one(spark, C.canonical(F.col("t")), t="ab​c") == "abc"
    assert one(spark, C.tamper(F.col("t")), t="ab​c")["suspicious"]
    assert one(spark, C.join_hyphens(F.col("t")), t="inter-\nnational") == "international"
    assert one(spark, C.clean(F.col("t")), t="Hello   world !") == "Hello world!"


def test_canonical_twice(spark):
    for text in ("pаper -\n x", "  a  b , c", ""):
        once = one(spark, C.canonical(F.col("t")), t=text)
        assert one(spark, C.canonical(F.col("t")), t=once) == once


def test_tokenizers_differ(spark):
    assert one(spark, C.tok_word(F.col("t")), t="naïve café") == ["naïve", "café"]
    assert one(spark, C.tok_latin(F.col("t")), t="naïve café") == ["na", "ve", "caf"]


@pytest.mark.parametrize("v, want", [([3.0, 8.0, 3.0, 3.0, 9.0], 2), ([], 0), ([1.0], 1), ([9.0], 0)])
def test_valleys(spark, v, want):
    assert one(spark, features.valleys(F.col("v"), 7.0), v=v) == want


def test_smooth(spark):
    assert one(spark, style.smooth(F.col("v")), v=[1.0, 1.0, 1.0]) == [0.75, 1.0, 0.75]


def test_transition(spark):
    assert one(spark, style.transition(F.transform("v", lambda x: x > 5)), v=[9.0, 1.0, 2.0, 8.0]) == 3
    assert one(spark, style.transition(F.transform("v", lambda x: x > 5)), v=[9.0, 8.0]) is None


def test_entropy(spark):
    assert one(spark, C.entropy(C.run_counts(F.split("t", " "))), t="a a b b") == 1.0


def test_short_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "wait, wait " * 9 + "end.")], "doc_id long, text string")
    assert [r["style_v7"]["word_count"] for r in features.style_v7(d).orderBy("doc_id").collect()] == [0, 0, 2, 19]
    assert {r["reasoning"]["type_token_ratio"] for r in features.reasoning(d).collect()} == {0.0}
    assert [r["perplexity"]["proxy_perplexity_mean"] > 0 for r in features.perplexity(d).orderBy("doc_id").collect()] == [False, False, False, True]
    assert {len(r["style_vector"]) for r in style.stylometric(d).collect()} == {216}


def test_proxy_perplexity_of_two_tokens(spark):
    assert one(spark, features.proxy_perplexity(F.split("t", " ")), t="a b") == 10.0


def test_markers(spark):
    text = "First, let me think step by step. But wait, let me reconsider this. Therefore it follows that of course we need to do it again and again because it is so."
    r = features.reasoning(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]["reasoning"]
    assert r["backtracking_density"] > 0 and r["cot_scaffold_density"] > 0 and r["consequence_density"] > 0 and r["intuition_leap_density"] > 0


def test_citations(spark):
    text = "As (Smith, 2023) says, and Smith (2023) again.\nReferences\nSmith, J. (2023). A good title. doi:10.1234/abc\nDoe, A. (1850). Another title here."
    assert one(spark, citations.inline(citations.split_bibliography(F.col("t"))["body"]), t=text) == ["Smith, 2023"]
    refs = one(spark, citations.references(F.col("t")), t=text)
    assert [(r["year"], r["title"]) for r in refs] == [(2023, "A good title"), (1850, "Another title here")]
    odd = spark.range(1).select(citations.offline(F.lit(1850), F.lit(""), 2025).alias("o")).collect()[0]["o"]
    assert (odd["score"], odd["date_anomaly"]) == (20.0, True)
    assert citations.surnames("Smith, J. A., Doe, B. C., & White-Hall, E.") == ["smith", "doe", "white-hall"]


def test_confidence(spark):
    rows = [("A study of things", ["smith"], 2020, "Nature", "A study of things", ["smith"], 2020, "Nature"), ("Abc", ["doe"], 1990, "", "Zzzzz qqqq", ["roe"], 2020, "")]
    d = spark.createDataFrame(rows, "title string, authors array<string>, year int, journal string, c_title string, c_authors array<string>, c_year int, c_journal string")
    assert [r["confidence"] for r in citations.confidence(d).collect()] == [100.0, 0.0]


def test_watermark():
    import numpy as np

    ids = [5]
    while len(ids) < 200:  # always a token from variant 0's green part
        ids.append(int(np.flatnonzero(watermark.green(watermark.context_hash(ids[-1:], 0), 1000, 0.5))[len(ids) % 400]))
    assert watermark.green_z(ids)["z"] > 10
    assert watermark.green_z([1, 2, 3]) == {"z": 0.0, "p": 1.0, "green": 0.5}
    assert watermark.periodicity(np.tile([0.0, 1, 2, 1], 20)) > 0.9 and watermark.periodicity(np.ones(50)) == 0.0


def test_report(spark):
    s = report.sentence_scores(F.col("t"), F.lit(0.7))
    found = one(spark, s, t="Furthermore we delve. Gonna be cool stuff! Plain words here?")
    assert [x["indicators"] for x in found] == [["AI indicator: 'furthermore'", "AI indicator: 'delve'"], [], []]
    assert found[0]["score"] > found[2]["score"] > found[1]["score"]
    assert one(spark, report.hybrid(F.col("v")), v=[0.9, 0.9, 0.9, 0.1, 0.1, 0.1]) and not one(spark, report.hybrid(F.col("v")), v=[0.9, 0.1])


def test_signature_limits(spark):
    d = spark.createDataFrame([("a", "word " * 3 + "words words cat cat cat"), ("b", None)], "source string, text string")
    assert [(r["word"], r["n"]) for r in style.signature_words(d, "source").collect()] == [("word", 3)]


def test_candidates_of_common_words(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(9)]
    works = [(k, " ".join(rng.sample(words, rng.randint(1, 4))), ["x"], 2000, "j") for k in range(300)]
    refs = [(k, " ".join(rng.sample(words, rng.randint(1, 5)))) for k in range(40)] + [(90, "nothing alike"), (91, "a b"), (92, None)]
    found = citations.candidates(spark.createDataFrame(refs, "ref_id long, title string"), spark.createDataFrame(works, "work_id long, c_title string, c_authors array<string>, c_year int, c_journal string")).collect()
    for k, title in refs:
        shared = sorted((-len(set((title or "").split()) & set(w[1].split())), w[0]) for w in works)
        want = [i for n, i in shared[:3] if n < 0]
        assert sorted(r["work_id"] for r in found if r["ref_id"] == k and r["work_id"] is not None) == sorted(want)
        assert [r["ref_id"] for r in found].count(k) == max(1, len(want))


def test_quick_compare_is_plain_arithmetic(spark):
    samples = ["One day, we sat by the sea and ate bread.", "The sea was calm; nobody spoke, and we ate.", "Bread again! We did not mind it, by the sea."]
    docs = spark.createDataFrame([(1, samples[0]), (2, "Utterly different: 12 numbers, 9 words? No, none at all."), (3, None)], "doc_id long, text string")
    vectors = lambda df: [np.array(r["style_vector"]) for r in style.stylometric(df).collect()]
    known = np.array(vectors(spark.createDataFrame([(x,) for x in samples], "text string")))
    mean, std = known.mean(0), np.where(known.std(0) < 1e-9, 1.0, known.std(0))
    profile = (vectors(spark.createDataFrame([(" ".join(samples),)], "text string"))[0] - mean) / std
    cosine = lambda a, b: max(0.0, a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    got = {r["doc_id"]: r for r in style.quick_compare(docs, samples).collect()}
    for k, v in zip((1, 2, 3), vectors(docs.orderBy("doc_id")), strict=True):
        assert abs(got[k]["similarity"] - cosine(profile, (v - mean) / std)) < 1e-6
        assert got[k]["comparison"]["same_author"] == (got[k]["similarity"] >= got[k]["threshold"])
    fixed = style.quick_compare(docs, samples[:2], scorer=lambda a, b: F.lit(7.0), embed=lambda t: F.array(F.lit(1.0), F.lit(0.0))).collect()
    assert {(r["similarity"], r["threshold"]) for r in fixed} == {(1.0, 0.8)}
    with pytest.raises(ValueError):
        style.quick_compare(docs, [])


def test_rendering_of_nothing(spark):
    from stylograph.operators import render

    r = F.expr("struct('Human' AS prediction, 1d AS human, 0d AS ai, 62.5d AS confidence, 'unknown' AS model, cast(null AS string) AS forensic, cast(null AS struct<level:string,risk:double>) AS hallucination, cast(null AS struct<detected:boolean,scheme:string,confidence:double>) AS watermark, cast(null AS double) AS reasoning, cast(null AS array<string>) AS errors)")
    row = spark.range(1).select(r.alias("r")).select(render.markdown(F.col("r")), render.short_summary(F.col("r")), render.detector_markdown(F.col("r"))).collect()[0]
    assert row[0] == "**The text is** <span class='highlight-human'>**100.00%** likely <b>Human written</b>.</span>"
    assert row[1] == "[Human] conf=62.5% model=unknown forensic=N/A hal=N/A wm=NO errors=0" and row[2].endswith("**62.50%** likely <b>Human written</b>.</span>")
