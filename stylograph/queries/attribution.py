"""Nearest vectors and authors by an index, and the stacked meta-model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features, index, risk, stacking, style
from ..session import Stage
from .text import docs


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _nearest(spark, d):
    """The 10 nearest vectors of every twentieth one, exactly."""
    stage, e = Stage(spark, "index"), _vectors(spark, d)
    found = index.search(index.build(e, stage, "vec_id", "v"), e.filter("vec_id % 20 = 0"), stage, "vec_id", "v", 10, exact=True, same=True)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 5).alias("score"))


def _recall(spark, d):
    """What tuned probes find of the 10 nearest of every twentieth vector: embeddings, and the documents' style vectors."""
    s = style.stylometric(docs(spark, d).select("doc_id", "text")).select(F.col("doc_id").alias("vec_id"), F.col("style_vector").alias("v"))
    out = None
    for name, e in (("embeddings", _vectors(spark, d)), ("style", s)):
        stage = Stage(spark, "recall")
        e = stage.table(e.select("vec_id", "v"), "vectors")
        built, asked = index.build(e, stage, "vec_id", "v"), e.filter("vec_id % 20 = 0")
        probes = index.tuned(built, asked, stage, "vec_id", "v", same=True)
        true = stage.table(index.search(built, asked, stage, "vec_id", "v", exact=True, same=True), "all")
        found = index.search(built, asked, stage, "vec_id", "v", probes=probes, same=True)
        part = true.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).select(F.lit(name).alias("vectors"), F.lit(probes).alias("probes"), F.lit(len(built.centroids)).alias("cells"), "n", F.round("recall", 4).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out


def _authors(spark, d):
    """Each document's three likeliest labels of embeddings, by a scorer of the caller's over what the index finds."""
    stage, e = Stage(spark, "authors"), _vectors(spark, d)
    profiles = style.centroids(e, "label", "v", 64).select(F.col("author").cast("string").alias("author"), "mean")
    scorer = lambda a, b: style.cosine(a, b) * 0.5 + 0.5
    found = index.attribute(e, profiles, stage, "vec_id", "v", "author", "mean", scorer, 3, exact=True)
    return found.select(F.col("doc").cast("long").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "author", F.round("score", 5).alias("score"))


def _meta(spark, d):
    """Branch scores of documents against the labels of quality: what cross-fitted models of either kind reach on rows they haven't seen."""
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null").select("doc_id", F.col("quality").cast("int").alias("y"))
    f = docs(spark, d).select("doc_id", "text").join(labels, "doc_id")
    for profile in (features.hallucination, features.reasoning, features.perplexity, features.style_v7):
        f = profile(f)
    tokens = F.size(C.tok_word(F.coalesce("text", F.lit(""))))
    f = f.select("doc_id", "y", risk.hallucination_risk(F.col("hallucination"))["score"].alias("hallucination"), risk.reasoning_risk(F.col("reasoning"))["score"].alias("reasoning"), risk.perplexity_risk(F.col("perplexity"), tokens).alias("perplexity"), "style_v7.type_token_ratio", "style_v7.burstiness", "style_v7.stopword_ratio", "style_v7.uppercase_ratio")
    names = [c for c in f.columns if c not in ("doc_id", "y")]
    stage = Stage(spark, "meta")
    rows = stage.table(f, "branches")
    out = None
    for kind in ("linear", "heuristic"):
        own = Stage(spark, f"meta-{kind}")
        part = stacking.held_out(stacking.cross_fitted(rows, names, own, kind=kind)).select(F.lit(kind).alias("kind"), "n", F.round("accuracy", 4).alias("accuracy"), F.round("auroc", 4).alias("auroc"))
        out = part if out is None else out.unionByName(part)
    return out


COSINES = "SELECT q.vec_id AS query, p.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0"
ALL = {
    "ml_index_nearest": (_nearest, f"SELECT query, rank, id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM ({COSINES})) WHERE rank <= 10"),
    "ml_index_recall": (_recall, None),
    "ml_index_authors": (
        _authors,
        """WITH c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding[1:64]::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL) GROUP BY label),
            s AS (SELECT vec_id, CAST(label AS VARCHAR) AS author, list_cosine_similarity(embedding::DOUBLE[], m) AS s FROM (SELECT vec_id, embedding FROM embeddings) CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, author) AS near FROM s),
            t AS (SELECT vec_id, author, greatest(0, least(1, s)) * 0.5 + 0.5 AS score FROM r WHERE near <= 3) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, author) AS rank, author, round(score, 5) AS score FROM t""",
    ),
    "ml_meta": (_meta, None),
}
