"""Evidence rules and summaries against plain Python, on random signals with gaps; each kind and each sentence is reached."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylograph.functions import lexicons as L
from stylograph.operators import ensemble, evidence, render, report, style

SCHEMA = """id long, verdict string, confidence double, words int, neural double, statistical double, reasoning_score double, watermark_score double,
    sentences array<struct<position:int,text:string,score:double,indicators:array<string>>>, human_words boolean, word_stats struct<mean:double,high:long,ai:long,human:long>,
    statistics struct<ppl:double,burstiness:double,lexical_diversity:double,avg_sentence_length:double>, baseline array<struct<metric:string,value:double,human:double>>,
    style struct<burstiness:double,lexical_diversity:double,hapax_ratio:double,sentence_length_variance:double,complex_sentence_ratio:double>,
    hallucination struct<level:string,risk:double,categories:array<struct<category:string,score:double>>>, reasoning struct<score:double,level:string>,
    watermark struct<detected:boolean,scheme:string,confidence:double>, perplexity struct<score:double,level:string,tier:string,mean:double,entropy:double,low:double,valleys:double>,
    references struct<total:int,fabricated:double,chimeric:double,ornamental:double,level:string>"""


def given(rng, k):
    u, maybe = rng.random, lambda x, share=0.2: None if rng.random() < share else x
    base = rng.choice([0.1, 0.5, 0.9])
    n = rng.choice([0, 1, 3, 4, 9])
    spread = rng.choice([0.0, 0.01, 0.3])
    sentences = [{"position": i, "text": rng.choice(["short", "a long sentence " * 12]), "score": min(1.0, max(0.0, base + rng.uniform(-spread, spread))), "indicators": rng.choice([[], ["x"], ["a", "b", "c", "d"]])} for i in range(n)]
    style = {"burstiness": maybe(rng.uniform(-0.5, 0.5)), "lexical_diversity": maybe(u()), "hapax_ratio": maybe(u()), "sentence_length_variance": maybe(rng.choice([5.0, 100.0, 300.0])), "complex_sentence_ratio": maybe(u())}
    return {
        "id": k, "verdict": rng.choice(["AI-Generated", "Human-Written", "Hybrid", "Inconclusive"]), "confidence": u(), "words": 200, "neural": u(), "statistical": rng.choice([0.5, u()]), "reasoning_score": u(), "watermark_score": u() / 5,
        "sentences": sentences, "human_words": u() < 0.5, "word_stats": {"mean": maybe(u()), "high": rng.randrange(400), "ai": rng.randrange(3), "human": rng.randrange(2)},
        "statistics": maybe({"ppl": maybe(rng.uniform(5, 60)), "burstiness": maybe(rng.uniform(0.1, 0.4)), "lexical_diversity": maybe(rng.uniform(0.4, 1)), "avg_sentence_length": maybe(rng.uniform(8, 25))}),
        "baseline": rng.choice([[], [{"metric": "m", "value": 10.0, "human": 10.0}], [{"metric": "m", "value": 20.0, "human": 10.0}, {"metric": "z", "value": 1.0, "human": 0.0}, {"metric": "l", "value": 5.0, "human": 10.0}]]),
        "style": maybe(style), "hallucination": maybe({"level": rng.choice(["LOW", "MEDIUM", "HIGH"]), "risk": u(), "categories": [{"category": c, "score": round(u(), 3)} for c in [*L.CATEGORY_NAMES, "other"]]}),
        "reasoning": maybe({"score": u(), "level": rng.choice(["HIGH — x", "MEDIUM", "LOW"])}), "watermark": maybe({"detected": u() < 0.5, "scheme": maybe("g"), "confidence": maybe(u())}),
        "perplexity": maybe({"score": u(), "level": rng.choice(["HIGH", "MEDIUM", "LOW", "INSUFFICIENT_TEXT"]), "tier": rng.choice(["tier1", "tier2"]), "mean": 5.0, "entropy": 4.0, "low": u(), "valleys": float(rng.randrange(4))}),
        "references": maybe({"total": rng.randrange(4), "fabricated": u(), "chimeric": rng.choice([0.0, 0.2]), "ornamental": u(), "level": rng.choice(["HIGH", "MEDIUM", "LOW"])}),
    }


def kinds(r):
    """(type, score, names) in order."""
    out, s = [], r["sentences"]
    scores = [x["score"] for x in s]
    mean, std = (statistics.fmean(scores), statistics.pstdev(scores)) if s else (0.0, 0.0)
    high, low = [x for x in s if x["score"] > 0.6][:5], [x for x in scores if x < 0.4]
    out += [("high_confidence_ai_sentence", x["score"], x["indicators"] or [L.NO_SIGNAL]) for x in high]
    human = not high and bool(low)
    if human:
        out.append(("human_writing_indicators", statistics.fmean(low), None))
    if len(s) >= 3 and std < 0.08 and mean > 0.5:
        out.append(("uniform_high_ai_scores", mean, None))
    if not r["human_words"] and len(s) >= 3 and not human:
        out.append(("absent_human_markers", None, None))
    st, y = r["statistics"] or {}, r["style"] or {}
    is_ = lambda v, test: v is not None and test(v)
    if is_(st.get("ppl"), lambda v: v < 20):
        out.append(("low_perplexity", st["ppl"], None))
    odd = [n for n, on in (("low burstiness", is_(y.get("burstiness"), lambda v: v < 0.12)), ("low lexical diversity", is_(y.get("lexical_diversity"), lambda v: v < 0.4)), ("low hapax ratio", is_(y.get("hapax_ratio"), lambda v: v < 0.3)),
                           ("high sentence length variance", is_(y.get("sentence_length_variance"), lambda v: v > 200) and is_(y.get("burstiness"), lambda v: v >= 0.12))) if on]
    if odd:
        out.append(("stylometric_anomaly", None, odd))
    h = r["hallucination"] or {"categories": [], "level": ""}
    risky = [(L.CATEGORY_NAMES.get(c["category"], c["category"]), c["score"]) for c in h["categories"] if c["score"] >= 0.6]
    out += [("high_hallucination_category", v, [n]) for n, v in risky]
    off = [n for k, (p, n) in L.STATISTICS_OF_PEOPLE.items() if is_(st.get(k), lambda v, p=p: abs(v - p) / p > 0.3)]
    if off:
        out.append(("statistical_deviation_from_baseline", None, off))
    if h["level"] == "HIGH":
        out.append(("high_hallucination_risk", h["risk"], None))
    elif h["level"] == "MEDIUM" and risky:
        out.append(("elevated_hallucination_categories", None, [n for n, _ in risky]))
    if r["reasoning"]:
        if r["reasoning"]["level"].startswith("HIGH"):
            out.append(("high_reasoning_model_signal", r["reasoning"]["score"], None))
        elif "MEDIUM" in r["reasoning"]["level"]:
            out.append(("moderate_reasoning_model_signal", r["reasoning"]["score"], None))
    if (r["watermark"] or {}).get("detected"):
        out.append(("candidate_watermark_signal", r["watermark"]["confidence"], [r["watermark"]["scheme"]]))
    if p := r["perplexity"]:
        if "HIGH" in p["level"]:
            out.append(("high_perplexity_ai_signal", p["score"], None))
        if p["valleys"] >= 2:
            out.append(("perplexity_valley_detected", None, None))
    if c := r["references"]:
        if "HIGH" in c["level"]:
            out.append(("fabricated_citations_detected", c["fabricated"], None))
        if c["chimeric"] > 0:
            out.append(("chimeric_citations_detected", c["chimeric"], None))
        if c["ornamental"] > 0.3:
            out.append(("ornamental_references", c["ornamental"], None))
    return out


def plan(r, n_evidence):
    v = r["verdict"]
    out = ["overall_" + ("ai" if "AI" in v else "human" if "Human" in v else "hybrid" if "Hybrid" in v else "inconclusive"), "scores"]
    w = r["word_stats"]
    if w["mean"] is not None:
        out.append("words_ai" if w["mean"] > 0.7 else "words_mixed" if w["mean"] > 0.4 else "words_human")
    out += [k for k, on in (("ai_words", w["ai"] > 0), ("human_words", w["human"] > 0), ("no_signal_words", not w["ai"] and not w["human"])) if on]
    scores = [x["score"] for x in r["sentences"]]
    if n := len(scores):
        high = sum(x > 0.7 for x in scores)
        out.append("sentences_" + ("all" if high == n else "most" if high > n * 0.6 else "some" if high else "none"))
        if n >= 3 and statistics.pstdev(scores) < 0.03:
            out.append("uniform_human" if "Human" in v else "uniform_ai")
    if r["baseline"]:
        off = [b for b in r["baseline"] if b["human"] > 0 and abs(b["value"] - b["human"]) / b["human"] > 0.3]
        out.append("baseline_normal" if not off else "baseline_off_human" if "Human" in v else "baseline_off")
    y = r["style"] or {}
    b, d, h, x, c = (y.get(k) for k in ("burstiness", "lexical_diversity", "hapax_ratio", "sentence_length_variance", "complex_sentence_ratio"))
    low_b = b is not None and b < 0.12
    if low_b or (b or 0) > 0.3 or d is not None and (d < 0.35 or d > 0.65) or h is not None and h < 0.25 or x is not None and (x < 15 or x > 200 and not low_b) or c is not None and c < 0.15:
        out.append("style")
    if r["hallucination"]:
        out.append("hallucination_" + r["hallucination"]["level"].lower())
    if r["reasoning"]:
        out.append("reasoning_" + next((k.lower() for k in ("HIGH", "MEDIUM") if k in r["reasoning"]["level"]), "low"))
    if p := r["perplexity"]:
        out += ["perplexity_" + {"INSUFFICIENT_TEXT": "short"}.get(p["level"], p["level"].lower()), *["valleys"] * (p["valleys"] > 1)]
    if (c := r["references"]) and c["total"]:
        out += ["references_" + c["level"].lower(), *["chimeric"] * (c["level"] == "HIGH" and c["chimeric"] > 0), *["ornamental"] * (c["ornamental"] > 0.3)]
    return [*out, "evidence" if n_evidence else "no_evidence", "closing"]


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(8)
    rows = [given(rng, k) for k in range(400)]
    rows.append({**given(rng, 400), "sentences": [], "human_words": True, **dict.fromkeys(("statistics", "style", "hallucination", "reasoning", "watermark", "perplexity", "references"))})
    f = spark.createDataFrame(rows, SCHEMA)
    columns = {c: F.col(c) for c in f.columns if c != "id"}
    f = f.withColumn("evidence", evidence.evidence(columns))
    columns["evidence"] = F.col("evidence")
    f = f.withColumn("summary", evidence.summary(columns))
    page = report.report_html(F.lit("<t>"), {**columns, "summary": F.col("summary.text")})
    return rows, {r["id"]: r for r in f.select("id", "evidence", "summary", page.alias("page")).collect()}


def test_evidence(results):
    rows, got = results
    seen = set()
    for r in rows:
        found = [(e["type"], e["score"], e["names"]) for e in got[r["id"]]["evidence"]]
        want = kinds(r)
        seen |= {k for k, _, _ in want}
        assert [(k, n) for k, _, n in found] == [(k, n) for k, _, n in want]
        assert [x for _, x, _ in found] == [None if x is None else pytest.approx(x, abs=5.1e-5) for _, x, _ in want]
        assert all(e["explanation"] and "null" not in e["explanation"] for e in got[r["id"]]["evidence"])
    assert seen == set(L.EVIDENCE_NAMES) == {x.kind for x in evidence.RULES}


def test_summary(results):
    rows, got = results
    seen = set()
    for r in rows:
        want = plan(r, len(kinds(r)))
        seen |= set(want)
        assert got[r["id"]]["summary"]["plan"] == want
        text = got[r["id"]]["summary"]["text"]
        assert "null" not in text and text.endswith("alone.") and text.startswith("FINDING: this text of 200 words")
    assert len(seen) == 40, sorted(seen)
    r = next(r for r in rows if r["references"] and r["references"]["total"] == 3 and r["references"]["level"] == "HIGH")
    assert f"of 3, {r['references']['fabricated']:.0%} are in no catalogue" in got[r["id"]]["summary"]["text"]


def test_page(results):
    rows, got = results
    for r in rows[:50]:
        page = got[r["id"]]["page"]
        assert page.startswith("<!DOCTYPE html>") and "<title>&lt;t&gt;</title>" in page and page.count('class="gauge"') == 4
        assert page.count('<tr class="sentence"') == min(10, len(r["sentences"])) and page.count('<li class="evidence"') == min(8, len(kinds(r)))


def test_rules_without_their_columns(spark):
    f = spark.createDataFrame([(None, 0.9)], "watermark struct<detected:boolean,scheme:string,confidence:double>, x double")
    assert f.select(evidence.evidence({"watermark": F.col("watermark")}).alias("e")).first()["e"] == []
    assert f.select(evidence.evidence({}).alias("e")).first()["e"] == []
    assert f.select(evidence.summary({}).alias("s")).first()["s"]["plan"] == ["closing"]


def test_watermark_report(spark):
    schema = "r struct<detected:boolean,scheme:string,confidence:double,z:double,p:double,green:double,tokens:int,deviation:double,entropy:struct<mean:double,std:double,skew:double,range_ratio:double,periodicity:double>>"
    f = spark.createDataFrame([((True, "green_red", 0.8125, 3.14159, 0.0000123, 0.61, 200, 0.125, (2.5, 0.25, -0.1, 1.0, 0.3)),), ((False, "none", 0.0, 0.0, 1.0, 0.5, None, 0.0, None),)], schema)
    one, none = (r["x"].split("\n") for r in f.select(render.watermark_report(F.col("r")).alias("x")).collect())
    assert one[1:7] == ["status: candidate watermark", "confidence: 81.2%", "scheme: green_red", "z: 3.142", "p (corrected): 0.000012", "green share: 0.610"] and one[7] == "entropy mean (nats): 2.500" and len(one) == 15 and "tokens: 200" in one
    assert none[1] == "status: no signal" and "tokens: N/A" in none and len(none) == 10


def test_run_summary(spark):
    schema = """r struct<prediction:string,confidence:double,uncertain:boolean,model:string,human:double,ai:double,style:struct<burstiness:double,vocabulary:double,hapax:double>,
        reasoning:struct<score:double,level:string,top:array<struct<feature:string,value:double>>>,perplexity:struct<score:double,level:string,tier:string,mean:double,entropy:double,windows:int>,
        references:struct<total:int,score:double,level:string,verified:int,fabricated:int,chimeric:int>,watermark:struct<detected:boolean,scheme:string,confidence:double>,report:struct<verdict:string,neural:double,reasoning:double,watermark:double,path:string>>"""
    full = ("AI", 91.26, False, "GPT", 8.7, 91.3, (0.1, 0.2, 0.3), (0.5, "MEDIUM", [("a", 0.5), ("b", 0.25), ("c", 0.1), ("d", 0.05)]), (0.4, "LOW", "tier1", 6.5, 4.25, 3), (2, 0.25, "LOW", 1, 1, 0), (True, "g", 0.75), ("AI-Generated", 0.9, 0.5, 0.75, "out"))
    bare = ("Human", 60.0, True, None, 60.0, 40.0, None, None, None, None, None, None)
    f = spark.createDataFrame([(full,), (bare,)], schema)
    one, none = (r["x"].split("\n") for r in f.select(render.run_summary(F.col("r"), F.array(F.lit("x"), F.lit("y"))).alias("x")).collect())
    assert one == [
        "detection: AI, confidence 91.3% (decisive)", "likely model: GPT", "scores: human 8.7%, ai 91.3%", "style: burstiness 0.100, vocabulary 0.200, hapax 0.300", "reasoning: 0.5000 MEDIUM; a 0.500000, b 0.250000, c 0.100000",
        "perplexity: 0.4000 LOW tier1; mean 6.50, entropy 4.25, windows 3", "references: 2, 0.2500 LOW; verified 1, fabricated 1, chimeric 0", "watermark: yes, 0.7500, g", "report: AI-Generated, neural 0.90, reasoning 0.50, watermark 0.75, in out", "plugins: x, y",
    ]
    assert none == ["detection: Human, confidence 60.0% (uncertain)", "scores: human 60.0%, ai 40.0%", "plugins: x, y"]


def test_author_thresholds(spark):
    """Leave-one-out thresholds against numpy: authors of three samples or more, each sample against the mean of the others."""
    rng = np.random.default_rng(2)
    v = {a: rng.normal(size=(n, 5)) + shift for a, n, shift in (("x", 6, 1.0), ("y", 3, -1.0), ("z", 2, 0.0), (None, 4, 2.0))}
    f = spark.createDataFrame([(a, r.tolist()) for a, m in v.items() for r in m], "author string, v array<double>")
    got = {r["author"]: (r["n"], r["threshold"]) for r in style.thresholds(f, "author", "v", 5).collect()}
    want = {}
    for a, m in v.items():
        if len(m) < 3:
            continue
        mean, std = m.mean(0), m.std(0) + 1e-9
        sims = []
        for k in range(len(m)):
            p, q = ((np.delete(m, k, 0).mean(0) - mean) / std, (m[k] - mean) / std)
            sims.append(max(0.0, min(1.0, float(p @ q / (np.linalg.norm(p) * np.linalg.norm(q))))))
        want[a] = (len(m), pytest.approx(max(0.0, min(0.99, np.mean(sims) - np.std(sims))), abs=1e-9))
    assert got == want


def test_temperature(spark):
    """The temperature of least loss against a fine grid."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(120, 4)) * 3
    y = np.array([rng.choice(4, p=np.exp(r / 2.5) / np.exp(r / 2.5).sum()) for r in z])
    logits = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(z)], "doc_id int, logits array<double>")
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(y)], "doc_id int, label int")
    loss = lambda t: float(np.mean([np.log(np.exp(r / t).sum()) - r[k] / t for r, k in zip(z, y, strict=True)]))
    best = min(np.arange(0.5, 6, 0.01), key=loss)
    assert abs(ensemble.fit_temperature(logits, labels) - best) < 0.02

