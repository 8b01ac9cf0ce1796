"""The pipeline's stages one after the other, on rows with nulls, copies, secrets and repeats; and each query of the driver's."""

import os
import random

import pytest

import __spark_entry__
import corpus_pipeline
from stylograph.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    common = "the of and to in a is was for on".split()
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    line = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n))
    rows = [(k, "\n".join(line(rng.randint(25, 40)) for _ in range(5)), "en", "hot" if k % 2 else None) for k in range(60)]
    shared = line(60)
    rows += [(100 + k, f"{line(40)}\n{shared}\n{line(40)}", "en", "s") for k in range(3)]
    rows += [(200, rows[7][1], "en", "copy"), (201, rows[8][1] + " one more", "en", "near")]
    rows += [(300, f"{line(40)} password=hunter2hunter2 {line(40)}", "en", None), (301, None, None, None), (302, "", "en", "x"), (303, "###! " * 300, "en", "x"), (304, line(50), "en", "twice"), (None, line(60), None, None)]
    rows.append(rows[-2])
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    kept, now, seen = Scratch(spark, "t"), docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = kept.table(stage(spark, now, ""), f"s{k}")
        seen[name] = [r.asDict() for r in now.collect()]
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    ids = {k: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in v) for k, v in seen.items() if k != "packing"}
    texts = {k: {r["doc_id"]: r["text"] for r in v} for k, v in seen.items() if k != "packing"}
    assert not {301, 302, 303} & set(ids["quality rules"]) and set(range(60)) <= set(ids["quality rules"]) and ids["quality rules"].count(304) == 2
    assert not {200, 201} & set(ids["near duplicates"]) and ids["near duplicates"].count(304) == 1 and set(range(60)) <= set(ids["near duplicates"]) and -1 in ids["near duplicates"]
    shared = texts["near duplicates"][100].split("\n")[1]
    assert shared in texts["substring dedup"][100] and shared not in texts["substring dedup"][101] and texts["substring dedup"][3] == texts["near duplicates"][3]
    assert "[SECRET]" in texts["secret scans"][300] and "hunter2" not in texts["secret scans"][300] and texts["secret scans"][3] == texts["substring dedup"][3]
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secret scans"])
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["secret scans"]}


def test_near_duplicates_by_row(spark):
    """Rows are told apart by doc_id and text: copies go even where their doc_id has another text, or none."""
    a, b, c = ("the first text of some words " * 3, "something else entirely that has nothing in common " * 3, "a third one of its own kind " * 3)
    schema = "doc_id long, text string, lang string"
    kept = lambda rows: sorted(map(tuple, corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), "").select("doc_id", "text").collect()), key=str)
    assert kept([(1, a, "x"), (5, a, "x"), (5, b, "x")]) == sorted([(1, a), (5, b)], key=str)
    assert kept([(1, a, "x"), (None, a, "x"), (None, b, "x")]) == sorted([(1, a), (None, b)], key=str)
    assert kept([(None, a, "x"), (None, a, "y"), (None, None, None), (None, "", "z")]) == sorted([(None, a), (None, "")], key=str) or kept([(None, a, "x"), (None, a, "y"), (None, None, None), (None, "", "z")]) == sorted([(None, a), (None, None)], key=str)
    assert kept([(3, c, "x"), (3, c, "x"), (3, c, "y")]) == [(3, c)]


def test_runs_close_their_own_tables(spark, monkeypatch):
    closed, made = [], []

    class Counted(Scratch):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

        def close(self):
            closed.append(self)
            super().close()

    def fails(spark, docs, sf_dir):
        corpus_pipeline._scratch(spark, "x")
        raise RuntimeError("no")

    monkeypatch.setattr(corpus_pipeline, "Scratch", Counted)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, d, _: d), ("b", fails)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, SF)
    assert len(made) == 2 and set(closed) == set(made) and corpus_pipeline._open.get() is None


def test_stages_of_an_empty_table(spark, docs):
    now, kept = docs.filter("false"), Scratch(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = kept.table(stage(spark, now, ""), f"e{k}")
    assert now.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_toxicity_pu", "op4_language_mixture", "op6_media_sequences"])
def test_query(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_page_sequences_resolve(spark):
    got = {r["page_id"]: r for r in __spark_entry__.queries()["media_page_sequences"](spark, SF).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = {d["text"] or "" for k, d in docs.items() if k % 3}
    for k, r in got.items():
        d = docs.get(k)
        there = d is not None and (d["text"] or "") in texts
        assert (r["n_media"], r["n_resolved"]) == (int(d is not None), int(there))
        assert r["n_bytes"] == (len((d["text"] or "").encode()) if there else None) and (d is None or r["caption"] == (d["source"] or ""))
    assert sum(r["n_resolved"] for r in got.values()) > 10
