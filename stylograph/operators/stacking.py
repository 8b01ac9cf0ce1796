"""A stacked meta-model over branch scores, cross-fitted: no row's prediction comes from a model that has seen its label.

kind "tree": gradient-boosted trees; "linear": logistic regression on standardised features with balanced classes; "heuristic", where a
class is missing from what a model would learn from: the supervised score as it is, or .5 without one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stage
from . import metrics

#: The feature that the heuristic goes by.
SUPERVISED = "p_ai_supervised"


@dataclass
class Meta:
    kind: str
    features: list[str]
    model: Model | None = None


def _filled(features: list[str]) -> list[Column]:
    """Missing scores count as .5: they say nothing."""
    return [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0.5).otherwise(F.col(c).cast("double")).alias(c) for c in features]


def fit(rows: DataFrame, features: list[str], label: str = "y", kind: str = "tree", seed: int = 7) -> Meta:
    """rows: features and a label of 0 or 1 (rows with another one or none teach nothing)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    known = rows.filter(F.col(label).isin(0, 1)).select(*_filled(features), F.col(label).cast("double").alias("label"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2 or kind == "heuristic" or not features:
        return Meta("heuristic", features)
    gather = VectorAssembler(inputCols=features, outputCol="raw")
    if kind == "tree":
        return Meta("tree", features, Pipeline(stages=[gather, GBTClassifier(featuresCol="raw", maxIter=20, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=seed)]).fit(known))
    total = sum(n.values())
    weighed = known.withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
    stages = [gather, StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=100, regParam=0.0)]
    return Meta("linear", features, Pipeline(stages=stages).fit(weighed))


def predict(rows: DataFrame, meta: Meta, name: str = "p") -> DataFrame:
    """rows with the probability of class 1."""
    if meta.model is None:
        given = F.when(F.col(SUPERVISED).isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(SUPERVISED).cast("double")))) if SUPERVISED in meta.features else F.lit(0.5)
        return rows.withColumn(name, given)
    from pyspark.ml.functions import vector_to_array

    ready = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), *_filled(meta.features))
    out = meta.model.transform(ready)
    return out.select("_row.*", F.get(vector_to_array("probability"), F.lit(1)).alias(name))


def cross_fitted(rows: DataFrame, features: list[str], stage: Stage, id_col: str = "doc_id", label: str = "y", folds: int = 5, kind: str = "tree") -> DataFrame:
    """rows with fold, kind and p, each predicted by a model of the other folds. Folds go by id, so rows that repeat one share theirs."""
    cut = stage.table(rows.withColumn("fold", F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(folds)).cast("int")), "folds")
    out = None
    for k in range(folds):
        meta = fit(cut.filter(F.col("fold") != k), features, label, kind)
        part = predict(cut.filter(F.col("fold") == k), meta).withColumn("kind", F.lit(meta.kind))
        out = part if out is None else out.unionByName(part)
    return stage.table(out, "predicted")


def held_out(predicted: DataFrame, label: str = "y") -> DataFrame:
    """One row: n, accuracy at .5, auroc of cross-fitted predictions."""
    scored = predicted.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), "p")
    right = scored.agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    return right.join(metrics.auroc(scored), F.lit(True))  # two single rows
