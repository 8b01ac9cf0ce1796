"""Dictionaries, duplicates, splits, sources and sinks, streams, plugins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import corpus, watermark
from ..plans import plugins
from ..session import Stage
from ..sources import files
from ..streaming import counts
from .features import GRAMS, WORD, WS
from .text import docs

#: N-grams of each order that a dictionary holds.
TOP = 100_000
GRAM_SQL = f"""WITH d AS (SELECT {WORD} AS w FROM documents WHERE len({WS % 'text'}) >= 20),
g AS ({' UNION ALL '.join(f"SELECT {n} AS n, unnest({GRAMS % dict(w='w', n=n)}) AS ngram FROM d" for n in (2, 3, 4))}), c AS (SELECT n, ngram, count(*) AS cnt FROM g GROUP BY ALL)"""
SHINGLES = r"list_distinct(list_transform(range(1, greatest(2, length(t) - 3)), lambda i: substr(t, i, 5)))"
MINHASH_SQL = f"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents),
h AS (SELECT doc_id, list_transform({SHINGLES}, lambda x: ('0x' || substr(md5(x), 25, 8))::BIGINT) AS h FROM d),
s AS (SELECT doc_id, p, list_min(list_transform(h, lambda x: xor(x, (p * 2654435761) & 4294967295))) AS m FROM h, range(0, 64) r(p))
SELECT doc_id, md5(string_agg(CAST(m AS VARCHAR), ',' ORDER BY p)) AS sig FROM s GROUP BY doc_id"""


def _dictionary(spark, d):
    return corpus.ngram_dictionary(docs(spark, d), top=TOP)


def _minhash(spark, d):
    out = corpus.minhash(docs(spark, d).repartition(spark.sparkContext.defaultParallelism, "doc_id"))
    return out.select("doc_id", F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("sig"))


def _near(spark, d):
    return corpus.drop_near_duplicates(docs(spark, d), Stage(spark, "near")).select("doc_id")


def _split(spark, d):
    key = F.concat_ws("-", F.col("lang"), (F.col("doc_id") % 50).cast("string"))
    return corpus.split_groups(docs(spark, d).select("doc_id", "lang"), key).select("doc_id", "split")


SPLIT_SQL = """WITH k AS (SELECT doc_id, lang || '-' || CAST(doc_id % 50 AS VARCHAR) AS k FROM documents), g AS (SELECT DISTINCT k FROM k),
r AS (SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS r, count(*) OVER () AS n FROM g)
SELECT doc_id, CASE WHEN r <= floor(n * 0.1) THEN 'test' WHEN r <= 2 * floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM k JOIN r USING (k)"""


def _round_trip(write, end):
    def query(spark, d):
        path = Stage(spark, "src").path(f"data{end}")
        write(docs(spark, d).select("doc_id", "text", "lang"), path)
        return files.read_any(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text"), "lang")

    return query


def _csv(df, path):
    files.write_csv(df, path)


READ_SQL = "SELECT doc_id, md5(text) AS text, lang FROM documents"


def _dict_source(kind):
    def query(spark, d):
        path = Stage(spark, "src").path(f"texts.{kind}")
        base = docs(spark, d).select("text")
        _csv(base, path) if kind == "csv" else base.write.json(path)
        return files.dictionary_texts(spark, path, kind).select(F.md5("text").alias("text"))

    return query


DICT_SQL = rf"SELECT md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text FROM documents WHERE len({WS % 'text'}) >= 20"


def _stream(spark, d):
    stage = Stage(spark, "stream")
    docs(spark, d).repartition(2, "doc_id").write.parquet(stage.path("in"))
    source = spark.readStream.schema(docs(spark, d).schema).option("maxFilesPerTrigger", 1).parquet(stage.path("in"))
    counts.ngram_stream(source.select("text"), stage.path("counts"), stage.path("mark"), orders=(2,)).awaitTermination()
    return counts.counts_of(spark, stage.path("counts")).filter("cnt >= 3")


def _sink_dict(spark, d):
    path = Stage(spark, "dict").path("counts")
    files.write_dictionary(_dictionary(spark, d), path)
    return spark.read.parquet(path).select(F.col("n").cast("int").alias("n"), "ngram", "cnt")


def _plugins(spark, d):
    out, errors = plugins.run(docs(spark, d).select("doc_id", "text"), plugins.standard(plugins.Config(perplexity=False)))
    return out.select("doc_id", "reasoning_risk.level", F.col("hallucination_risk.level").alias("hallucination_level"), F.lit(len(errors)).alias("n_errors"))


def _green(spark, d):
    ids = docs(spark, d).select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: (F.col("doc_id") * 13 + i * i * 7 + i) % 1000).alias("ids"))
    return ids.select("doc_id", watermark.green_test("ids").alias("w")).select("doc_id", F.round("w.z", 6).alias("z"), F.round("w.p", 6).alias("p"), F.round("w.green", 6).alias("green"))


def _indicator(spark, d):
    """Documents' words met with a lexicon table."""
    words = spark.createDataFrame([(w,) for w in L.FUNCTION_WORDS], "word string")  # a fixed list
    each = docs(spark, d).select("doc_id", F.explode(C.tok_word(F.col("text"))).alias("word"))
    return each.join(F.broadcast(words), "word").groupBy("doc_id").agg(F.count("*").alias("hits"))


ALL = {
    "src_parquet_file": (lambda s, d: files.read_any(s, f"{d}/documents.parquet").select("doc_id", F.md5("text").alias("text"), "lang"), READ_SQL),
    "src_parquet_dir": (_round_trip(lambda df, p: df.repartition(3, "doc_id").write.parquet(p), ""), READ_SQL),
    "src_json": (_round_trip(lambda df, p: df.write.json(p), ".jsonl"), READ_SQL),
    "src_csv": (_round_trip(_csv, ".csv"), READ_SQL),
    "src_dict_csv": (_dict_source("csv"), DICT_SQL),
    "src_dict_jsonl": (_dict_source("jsonl"), DICT_SQL),
    "src_limit": (lambda s, d: files.limit_rows(docs(s, d).select("doc_id"), 100, "doc_id"), "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100"),
    "agg_ngram_dict": (_dictionary, GRAM_SQL + f", r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, ngram) AS r FROM c) SELECT CAST(n AS INT) AS n, ngram, cnt FROM r WHERE r <= {TOP}"),
    "sink_dict_json": (_sink_dict, GRAM_SQL + f", r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, ngram) AS r FROM c) SELECT CAST(n AS INT) AS n, ngram, cnt FROM r WHERE r <= {TOP}"),
    "agg_proxy_ppl_dict": (
        lambda s, d: corpus.dictionary_perplexity(docs(s, d), Stage(s, "dict").table(_dictionary(s, d), "top")).select("id", F.round("ppl", 6).alias("ppl")),
        GRAM_SQL
        + f""", r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, ngram) AS r FROM c) WHERE r <= {TOP}), z AS (SELECT n, sum(cnt) AS total, count(*) AS types FROM r GROUP BY n),
            a AS (SELECT doc_id, {WORD} AS w FROM documents), b AS (SELECT * FROM a WHERE len(w) >= 3), e AS ({' UNION ALL '.join(f"SELECT doc_id, len(w) AS len, {n} AS n, unnest({GRAMS % dict(w='w', n=n)}) AS ngram FROM b" for n in (2, 3, 4))})
            SELECT doc_id AS id, round(least(15.0, greatest(0.1, pow(2, -avg(log2((coalesce(r.cnt, 0) + 0.01) / (total + 0.01 * types))) + 1 / len))), 6) AS ppl FROM e JOIN z USING (n) LEFT JOIN r ON r.n = e.n AND r.ngram = e.ngram GROUP BY doc_id, len""",
    ),
    "jn_lexicon": (_indicator, f"SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest({WORD}) AS word FROM documents) WHERE word IN {tuple(sorted(set(L.FUNCTION_WORDS)))} GROUP BY doc_id"),
    "set_minhash": (_minhash, MINHASH_SQL),
    "set_dedup_exact": (
        lambda s, d: docs(s, d).groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"),
        "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)",
    ),
    "set_dedup_near": (_near, None),
    "set_split_group": (_split, SPLIT_SQL),
    "set_split_random": (
        lambda s, d: docs(s, d).select("doc_id", corpus.split_random(F.col("doc_id")).alias("split")),
        "SELECT doc_id, CASE WHEN ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 6))::BIGINT < 1677721 THEN 'test' ELSE 'train' END AS split FROM documents",
    ),
    "set_except_rows": (
        lambda s, d: docs(s, d).select("text").exceptAll(s.read.parquet(f"{d}/benchmark.parquet").select("text")).groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")),
        "SELECT md5(text) AS h, count(*) AS n FROM (SELECT text FROM documents EXCEPT ALL SELECT text FROM benchmark) GROUP BY 1",
    ),
    "str_ngram_dict": (_stream, GRAM_SQL + " SELECT CAST(n AS INT) AS n, ngram, CAST(cnt AS BIGINT) AS cnt FROM c WHERE n = 2 AND cnt >= 3"),
    "jn_plugin_merge": (_plugins, None),
    "fn_green_z": (_green, None),
}
