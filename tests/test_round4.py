"""Faults that the fourth round's findings name."""

import hashlib

ODD = [None, "", " \n", "...", " lead", "trail\r", "\ttab\t", "a\r\nb", "\x01", 'a "q", b\\', "İstanbul İ", "ΑΣ ασ", "a a b"]


def _documents(spark, path, texts):
    rows = [(i, t, ("en", None, "", "de ")[i % 4], "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")


def _by_sql(path, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con.execute(__spark_entry__.oracle_sql()[name]).fetchall()


def test_counts_of_a_text_without_words_are_null(spark, tmp_path):
    from stylograph.queries import QUERIES

    _documents(spark, tmp_path, ODD)
    got = sorted(map(tuple, QUERIES["agg_ttr_hapax"](spark, str(tmp_path)).collect()))
    assert got == sorted(_by_sql(tmp_path, "agg_ttr_hapax")) and got[1] == (1, None, None, None) and got[10] == (10, 2, 2, 2) and got[11] == (11, 1, 0, 1)


def test_csv_keeps_ends_of_texts_and_tells_empty_from_null(spark, tmp_path):
    from stylograph.queries import QUERIES

    _documents(spark, tmp_path, ODD)
    got = {r["doc_id"]: (r["text"], r["lang"]) for r in QUERIES["src_csv"](spark, str(tmp_path)).collect()}
    assert got == {i: (t if t is None else hashlib.md5(t.encode()).hexdigest(), ("en", None, "", "de ")[i % 4]) for i, t in enumerate(ODD)}


def test_the_baseline_reads_whole_texts(spark, tmp_path):
    from stylograph.queries import QUERIES

    _documents(spark, tmp_path, [*ODD, "Ba ba ba. " * 400 + "catastrophically incomprehensible " * 500])
    got = sorted(map(tuple, QUERIES["fn_baseline"](spark, str(tmp_path)).collect()))
    assert got == sorted(_by_sql(tmp_path, "fn_baseline"))
    assert max(r[2] for r in got if r[:2] == (len(ODD), "grade")) > 20


def test_sentences_and_words_are_scored_in_one_pass(spark):
    from pyspark.sql import functions as F

    from stylograph.operators import evidence, report

    texts = ["", " ", "...", "Furthermore, we (delve)! Firstly; first things? thus\x1cthere", "First́ thu‍s. del‍ve delvé GONNA be ½first² ​ ‎", "İ first. Kinda ⓐdelve ΑΣ. \x1f . é\xa0thing", "a. " * 50 + "like stuff! ", "_hence_ hence_ -hence- x　third", None]
    df = spark.createDataFrame([(t, k / 7) for k, t in enumerate(texts * 2)], "t string, p double")
    df = df.select("t", "p", report.scored(F.col("t"), F.col("p")).alias("x"), report.sentence_scores(F.col("t"), F.col("p")).alias("s"))
    df = df.select("t", "x.*", "s", evidence.word_stats(F.flatten(F.transform("s", lambda x: report.word_scores(x["text"], F.col("p"))))).alias("w"))
    for r in df.collect():
        assert (r["sentences"], r["stats"]) == (r["s"], r["w"]), r["t"]


def test_a_folder_of_texts_has_plain_files_alone(spark, tmp_path):
    import os

    import pytest

    from stylograph.sources import files

    texts = [f"text {i} é " + "word " * 25 for i in range(50)] + [None, "", "two\nlines " * 20]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    files.write_texts(df, f"file://{tmp_path}/texts")
    names = os.listdir(tmp_path / "texts")
    assert len(names) == len(texts) and all(n.endswith(".txt") for n in names)  # no checksum beside each
    got = [r["text"] for r in files.dictionary_texts(spark, f"file://{tmp_path}/texts", "folder").collect()]
    assert sorted(got) == sorted(t.strip() for t in texts if t and len(t.split()) >= 20)
    with pytest.raises(FileExistsError):
        files.write_texts(df, f"file://{tmp_path}/texts")
